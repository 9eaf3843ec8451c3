"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, the posterior decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.textbytes import IS_SPACE, Run, mix, runs, span_hashes, sum_by, windows

WINDOW = 8
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
#: Bytes of letters, and last bytes of words as prose has them: letters, digits, signs of sentences, closing brackets and quotes.
_LETTER = _UPPER | _LOWER
_LETTER[0x80:0xFF] = True
_USUAL_END = _LETTER.copy()
_USUAL_END[list(b"0123456789.,;:!?'\")]}")] = True


class Rule(NamedTuple):
    """Votes bad on a rate below or above bad, good on one inside good, and abstains else."""

    name: str
    bad: tuple[float, float]
    good: tuple[float, float]


#: Rules over rates: symbols, words that end oddly, that hold a letter and that repeat the word before (each by words), repeated
#: lines (by lines with a word), words in repeated windows (by words), capitals (by ASCII letters), exclamation marks (by
#: words), mean word length, and words that end a sentence (by words).
RULES = (
    Rule("symbols", (0, 0.10), (0, 0.01)),
    Rule("odd_ends", (0, 0.10), (0, 0.02)),
    Rule("letters", (0.80, 1), (0.95, 1)),
    Rule("adjacent", (0, 0.10), (0, 0.02)),
    Rule("dup_lines", (0, 0.30), (0, 0)),
    Rule("repeats", (0, 0.20), (0, 0.05)),
    Rule("capitals", (0, 0.30), (0.002, 0.10)),
    Rule("exclaims", (0, 0.25), (0, 0.02)),
    Rule("word_length", (3, 10), (4, 7)),
    Rule("sentences", (0.005, 1), (0.03, 0.20)),
)
N_RULES = len(RULES)


def measure(run: Run) -> dict[str, np.ndarray]:
    """Signals of each text of the run, from the whole text."""
    run.words()
    count = lambda mask: np.add.reduceat(mask, run.offs[:-1], dtype=np.int64)  # noqa: E731  every text has its end byte at least
    out = {"n_words": run.n_words.astype(np.int64)}
    out["word_chars"] = count(~IS_SPACE[run.buf] & ((run.buf & 0xC0) != 0x80))
    out["n_symbols"] = count(_SYMBOL[run.buf])
    # lines: each ends at a line feed or at the text's end byte
    ends = np.flatnonzero((run.buf == 10) | (run.buf == 0xFF))
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    has_word = np.searchsorted(run.starts, ends) > np.searchsorted(run.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    line_doc = np.searchsorted(run.offs, starts, "right") - 1
    lines = np.sort(np.rec.fromarrays([line_doc, span_hashes(run.buf, starts, ends)], names="d,h"), order=("d", "h")) if len(starts) else None
    dup = np.zeros(run.n, np.int64)
    if lines is not None and len(lines) > 1:
        dup += np.bincount(lines["d"][1:][(lines["d"][1:] == lines["d"][:-1]) & (lines["h"][1:] == lines["h"][:-1])], minlength=run.n)
    out["n_dup_lines"], out["n_lines"] = dup, np.bincount(line_doc, minlength=run.n).astype(np.int64)
    # words in windows that occur twice or more in the text
    words = run.word_hashes()
    adjacent = np.zeros(len(words), np.int64)
    adjacent[1:] = words[1:] == words[:-1]
    adjacent[run.word_offs[:-1][run.n_words > 0]] = 0
    out["_adjacent"] = sum_by(adjacent, run.word_offs)
    hashes, offs = windows(words, run.word_offs, WINDOW)
    win_doc = np.repeat(np.arange(run.n, dtype=np.uint64), np.diff(offs))
    hashes = mix(hashes + (win_doc + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    again = np.zeros(len(hashes), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    word = at - offs[win_doc[at].astype(np.int64)] + run.word_offs[win_doc[at].astype(np.int64)]
    steps = np.bincount(word, minlength=len(run.starts) + 1).astype(np.int64)
    steps[: len(run.starts) + 1] -= np.bincount(word + WINDOW, minlength=len(run.starts) + 1)[: len(run.starts) + 1]
    out["n_repeat_words"] = sum_by((np.cumsum(steps)[:-1] > 0).astype(np.int64), run.word_offs)
    last = run.buf[run.ends - 1]
    out["_stops"] = sum_by(np.isin(last, (33, 46, 63)).astype(np.int64), run.word_offs)
    out["_odd_ends"] = sum_by((~_USUAL_END[last]).astype(np.int64), run.word_offs)
    lettered = np.logical_or.reduceat(_LETTER[run.buf], run.starts) if len(run.starts) else np.zeros(0, bool)
    out["_lettered"] = sum_by(lettered.astype(np.int64), run.word_offs)
    out["_upper"], out["_lower"], out["_exclaims"] = count(_UPPER[run.buf]), count(_LOWER[run.buf]), count(run.buf == 33)
    return out


def rates(m: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, rules): what each rule looks at."""
    words = np.maximum(m["n_words"], 1)
    letters, lines = np.maximum(m["_upper"] + m["_lower"], 1), np.maximum(m["n_lines"], 1)
    by_words = {k: m[c] / words for k, c in (("symbols", "n_symbols"), ("odd_ends", "_odd_ends"), ("letters", "_lettered"), ("adjacent", "_adjacent"), ("repeats", "n_repeat_words"), ("exclaims", "_exclaims"), ("word_length", "word_chars"), ("sentences", "_stops"))}
    found = by_words | {"dup_lines": m["n_dup_lines"] / lines, "capitals": m["_upper"] / letters}
    return np.stack([found[r.name] for r in RULES], 1)


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, rules): 1 good, 0 abstains, -1 bad.  Texts without words abstain from all."""
    x = rates(m)
    bad, good = np.array([r.bad for r in RULES]), np.array([r.good for r in RULES])
    out = np.where((x < bad[:, 0]) | (x > bad[:, 1]), -1, np.where((x >= good[:, 0]) & (x <= good[:, 1]), 1, 0)).astype(np.int8)
    out[m["n_words"] == 0] = 0
    return out


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


@dataclass(frozen=True)
class VoteModel:
    """Log odds of good: before any vote, and what each rule's vote (bad, abstains, good) adds."""

    prior: float
    odds: tuple[tuple[float, float, float], ...]

    def posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.full(len(v), self.prior)
        for rule, each in enumerate(self.odds):
            odds += np.array(each)[v[:, rule] + 1]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


#: What rules are believed to do before any text is seen, as chances of (bad vote, abstaining, good vote) on good and on bad
#: texts, and the weight of this belief against the texts seen: it names the two kinds and keeps chances from 0.
BELIEF, BELIEF_WEIGHT = np.array([[0.02, 0.28, 0.70], [0.20, 0.40, 0.40]]), 0.03


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> VoteModel:
    """Expectation-maximisation over distinct vote patterns: the prior, and each rule's chance of each vote on good and on bad texts.

    Starts from texts without a bad vote as good.  Rules that look at like faults support each other, so their votes weigh more
    than a lone bad vote among good ones, which the posterior may overrule; a rule that never votes stays neutral.  Without
    votes the belief alone remains."""
    n_rules, total = patterns.shape[1], max(float(counts.sum()), 1.0)
    good = np.where((patterns == -1).any(1), 0.1, 0.9) if len(patterns) else np.zeros(0)
    for _ in range(rounds):
        weight = np.stack([good * counts, (1 - good) * counts])  # good, bad
        prior = (weight.sum(1) + BELIEF_WEIGHT * total * np.array([0.9, 0.1])) / (counts.sum() + BELIEF_WEIGHT * total)
        chance = np.empty((2, n_rules, 3))
        for kind in (0, 1):
            belief = BELIEF_WEIGHT * total * prior[kind]
            for v in range(3):
                chance[kind, :, v] = weight[kind] @ (patterns == v - 1) + belief * BELIEF[kind, v]
        chance /= chance.sum(2, keepdims=True)
        model = VoteModel(float(np.log(prior[0] / prior[1])), tuple(map(tuple, np.log(chance[0] / chance[1]).tolist())))
        now = model.posterior(patterns)
        if len(good) == 0 or np.abs(now - good).max() < 1e-9:
            break
        good = now
    return model


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = 3 ** np.arange(N_RULES, dtype=np.int64)
    total = np.zeros(3**N_RULES, np.int64)
    for batch in batches:
        for run in runs(batch.column(0)):
            total += np.bincount((votes(measure(run)) + 1) @ base, minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["pattern", "n"])


def fit(docs: DataFrame, text: str = "text") -> VoteModel:
    """The vote model of docs: vote patterns of all texts are counted in Spark (3^10 at most), EM runs on the counts."""
    found = docs.select(text).mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    found = sorted((r["pattern"], r["n"]) for r in found)
    code = np.array([p for p, _ in found], np.int64).reshape(-1, 1)
    return fit_votes(code // 3 ** np.arange(N_RULES) % 3 - 1, np.array([n for _, n in found], np.float64))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def _scores(model: VoteModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(1)):
                m = measure(run)
                failed, quality = base_failed(m), model.posterior(votes(m))
                columns = [batch.column(0).slice(run.first, run.n), *[pa.array(m[c], pa.int64()) for c in SIGNALS], pa.array(failed), pa.array(quality), pa.array(~failed & (quality >= 0.5))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return score


def score(docs: DataFrame, model: VoteModel | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Signals, base_failed, quality (posterior) and kept of every whole text; two passes over the texts, no shuffle of them.

    Null texts count as empty: no words, base_failed, not kept.  Repeated rows and null keys stay as they are.  Without
    rows the result is empty."""
    model = model or fit(docs, text)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scores(model), SCHEMA)


def keep(docs: DataFrame, model: VoteModel | None = None, text: str = "text") -> DataFrame:
    """The rows of docs that score would keep, all columns as they were."""
    model = model or fit(docs, text)
    at = docs.columns.index(text)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [np.zeros(0, bool)]
            for run in runs(batch.column(at)):
                m = measure(run)
                mask.append(~base_failed(m) & (model.posterior(votes(m)) >= 0.5))
            yield batch.filter(pa.array(np.concatenate(mask)))

    return docs.mapInArrow(select, docs.schema)
