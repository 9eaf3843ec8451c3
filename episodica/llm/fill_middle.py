"""Fill-in-the-middle rows by an index of distinct texts.

Documents are dealt by their texts' hashes, so that equal texts follow each other, each told by its whole content.  For each
distinct text the ends of its lines are kept once, as an Elias-Fano list (about two bits a line more than the logarithm of
its mean length), and every document of the text looks its own seeded cut up in that list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import bound_batches

#: Marks of the parts of a cut document.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bits of the unary part between entries of the directory.
STEP = 512


class EliasFano:
    """An ascending list of numbers below a bound: low bits packed, high bits in unary, with a directory for select."""

    def __init__(self, numbers: np.ndarray):
        numbers = np.asarray(numbers, np.int64)
        n = len(numbers)
        bound = int(numbers[-1]) + 1 if n else 1
        self.n, self.width = n, max(0, (bound // max(n, 1)).bit_length() - 1)
        low = numbers & (1 << self.width) - 1
        self.low = np.packbits((low[:, None] >> np.arange(self.width)) & 1 > 0, axis=None, bitorder="little")
        places = (numbers >> self.width) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, bool)
        high[places] = True
        self.high = np.packbits(high, bitorder="little")
        #: Numbers before every STEP-th bit of the unary part.
        self.before = np.searchsorted(places, np.arange(0, len(high) + 1, STEP))

    def __getitem__(self, k: int) -> int:
        """The k-th number."""
        block = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.high[block * STEP // 8 : (block + 1) * STEP // 8], bitorder="little")
        place = block * STEP + int(np.flatnonzero(bits)[k - int(self.before[block])])
        at = k * self.width
        span = np.unpackbits(self.low[at // 8 : (at + self.width + 7) // 8], bitorder="little")[at % 8 : at % 8 + self.width]
        low = int(span @ (1 << np.arange(self.width))) if self.width else 0
        return (place - k) << self.width | low

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.before.nbytes


def line_ends(text: str) -> np.ndarray:
    """The code points before the end of each line; a line holds its newline, the last one may have none."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(signs == 10) + 1
    return ends if not len(signs) or signs[-1] == 10 else np.append(ends, len(signs))


class Entry:
    """What the index knows of a text: its line ends, and whether it may be cut."""

    def __init__(self, text: str):
        self.text, self.ends = text, EliasFano(line_ends(text))
        self.whole = not text or PREFIX in text or SUFFIX in text or MIDDLE in text

    def end(self, k: int) -> int:
        return self.ends[k - 1] if k else 0


def _cut(entry: Entry, h: tuple[int, int, int, int], rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, prefix and middle code points, output) of one document."""
    n, text = entry.ends.n, entry.text
    if entry.whole or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = entry.end(a), entry.end(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _apply(rate: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = None, {}  # the hash of the rows at hand, and its texts: one, unless hashes collide
        for batch in batches:
            out = []
            for key, text, *h in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if key != held:
                    held, entries = key, {}
                entry = entries.get(text)
                if entry is None:
                    entry = entries[text] = Entry(text)
                out.append(_cut(entry, h, rate, suffix_first))
            n, form, prefix, middle, output = zip(*out, strict=True) if out else ((),) * 5
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(6), *columns], names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def seeds(key: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups, as numbers, of the hex sha256 of seed:key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, suffix_first: int = 50) -> DataFrame:
    """key, n (lines), form, prefix_chars, middle_chars and output of every row of docs.

    A text is cut after two seeded counts of its lines into prefix, middle and suffix; rate percent of the documents are
    (the others stay plain), suffix_first percent of these begin with the suffix (spm: <S>suffix<P>prefix<M>middle), the rest
    with the prefix (psm: <P>prefix<S>suffix<M>middle).  Empty and null texts and those that hold a mark stay plain; plain
    rows have null counts.  The seeds depend on key alone (null: the empty string), so reruns agree.  Rows that repeat a key
    are rows of their own; other columns, of any name, are left out.

    The texts are shuffled once, by ranges of (hash, key, row), so that copies of one text, however many, spread over as many
    tasks as their share asks for; in each task an index entry is made once per distinct text, and only the entry at hand
    is held."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("text").alias("hash"), "text", *[h.alias(f"h{k}") for k, h in enumerate(seeds(F.col("key"), seed), 1)], "key", F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("hash", "key", "row").sortWithinPartitions("hash").drop("row")
    out = dealt.mapInArrow(_apply(rate, suffix_first), f"key {dict(rows.dtypes)['key']}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("key", key)


def restored(form: str = "form", output: str = "output") -> Column:
    """The document's text, rebuilt from its form and output.

    No part holds a mark, and no mark begins inside another, so the first of each is the one that was put there."""
    out = F.col(output)
    start = {name: F.locate(mark, out) for name, mark in (("P", PREFIX), ("S", SUFFIX), ("M", MIDDLE))}
    part = lambda a, b: F.substring(out, start[a] + 3, F.when(F.lit(b == ""), F.char_length(out)).otherwise(start[b or a] - start[a] - 3))
    psm, spm = F.concat(part("P", "S"), part("M", ""), part("S", "M")), F.concat(part("P", "M"), part("M", ""), part("S", "P"))
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", psm).otherwise(spm)
