"""Word-piece counts by a linear longest-match automaton.

The vocabulary's trie has two roots: one for pieces that begin a word, one for pieces inside it.  Every node has a failure
link, the node reached after greedily splitting off pieces from its string, and the number of pieces so popped.  A word is
read once, character by character; failing adds the popped count.  No piece is built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.textbytes import runs, sum_by

#: Distinct words whose counts a worker remembers before it starts afresh.
MOST_WORDS = 1_500_000
COUNTS = "doc_id long, n_words long, n_tokens long, n_unknown long"


class Automaton:
    """count(word): pieces of the greedy longest-match split, 0 if the word can't be split.

    bare_mark: the word mark is a piece of its own, which is popped first where no head begins the word."""

    def __init__(self, heads: Iterable[str], inner: Iterable[str], bare_mark: bool = False):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0 begins words, node 1 goes on
        final = [False, False]
        for root, pieces in ((0, heads), (1, inner)):
            for piece in pieces:
                u = root
                for c in piece:
                    v = self.next[u].get(c)
                    if v is None:
                        v = self.next[u][c] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    u = v
                if u != root:
                    final[u] = True
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        if bare_mark:
            self.fail[0], self.popped[0] = 1, 1
        queue = deque((0, 1))
        while queue:  # parents before children
            u = queue.popleft()
            for c, v in self.next[u].items():
                if final[v]:
                    self.fail[v], self.popped[v] = 1, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], n
                queue.append(v)

    def count(self, word: str) -> int:
        go, fail, popped, u, n = self.next, self.fail, self.popped, 0, 0
        for c in word:
            v = go[u].get(c)
            while v is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 0
                v = go[u].get(c)
            u = v
        while u != 1:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 0
        return n


_workers: dict[str, tuple[Automaton, dict[int, int]]] = {}


def _worker(model: str) -> tuple[Automaton, dict[int, int]]:
    """The worker's automaton for a sentencepiece model file, whose word mark begins words, and the counts so far by word hash."""
    if model not in _workers:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        _workers[model] = Automaton([x[1:] for x in pieces if x[0] == "▁"], pieces, "▁" in pieces), {}
    return _workers[model]


def _counts(model: str):
    schema = pa.schema([(c.split()[0], pa.int64()) for c in COUNTS.split(", ")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _worker(model)
        for batch in batches:
            for run in runs(batch.column(1)):
                run.words()
                values, first, back = np.unique(run.word_hashes(), return_index=True, return_inverse=True)
                if len(known) > MOST_WORDS:
                    known.clear()
                data, counts = run.buf.tobytes(), []
                for value, start, end in zip(values.tolist(), run.starts[first].tolist(), run.ends[first].tolist(), strict=True):
                    n = known.get(value)
                    if n is None:
                        n = known[value] = automaton.count(data[start:end].decode("utf-8", "replace"))
                    counts.append(n)
                each = np.array(counts, np.int64)[back] if len(counts) else np.zeros(0, np.int64)
                tokens, unknown = sum_by(np.maximum(each, 1), run.word_offs), sum_by((each == 0).astype(np.int64), run.word_offs)
                columns = [batch.column(0).slice(run.first, run.n), pa.array(run.n_words), pa.array(tokens), pa.array(unknown)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return count


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every whole text.

    Words are [^\\x20\\x09-\\x0D]+.  n_tokens sums the greedy longest-match pieces of the words over the model's pieces;
    a word that can't be split counts as one unknown token.  Null and empty texts have none; repeated rows stay; null keys
    stay null.  Each distinct word is read by the automaton once per worker.  No shuffle."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_counts(model), COUNTS)
