"""Vectorised word handling over Arrow string batches.

A batch of texts is laid out as one UTF-8 byte buffer in which every text is
followed by one end byte, so that words, windows and hashes of thousands of
texts come from a few NumPy passes instead of a Python loop per text.  Batches
are cut into runs of about ``RUN_BYTES`` to bound temporary memory; a text that
is longer than this forms a run of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 19
#: Bytes of a text that are hashed at once.
HASH_BYTES = 1 << 20
END = 0xFF  # never a byte of UTF-8

#: White space of the word pattern [^\x20\x09-\x0D]+; the end byte counts as white space too.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, END]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT_CODES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    """Returns freed memory to the system: workers live for many tasks, and would keep the peak of each."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, kept for the worker's life."""
    if len(_powers[0]) < n:
        size = max(n, RUN_BYTES + (RUN_BYTES >> 1))
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which follow each other: equal spans have equal hashes.

    Long buffers are worked through in parts of HASH_BYTES, so tables and temporary arrays don't grow with a text."""
    if len(buf) > HASH_BYTES:
        out, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            low = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, low + HASH_BYTES, "right")))
            part = buf[low : int(ends[to - 1])]
            out[at:to] = span_hashes(part, starts[at:to] - low, ends[at:to] - low) if len(part) <= HASH_BYTES else _long_span(part)
            at = to
        return out
    power, inverse = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def _long_span(buf: np.ndarray) -> np.ndarray:
    """The hash of one span longer than HASH_BYTES, as span_hashes would give it."""
    power, _ = _power_tables(HASH_BYTES + 1)
    total = 0
    for at in range(0, len(buf), HASH_BYTES):
        part = buf[at : at + HASH_BYTES]
        total += int((_BYTE_CODES[part] * power[: len(part)]).sum()) * pow(_BASE, at, 1 << 64)
    return mix(np.array([total & ((1 << 64) - 1)], np.uint64))


class Run:
    """Some consecutive texts of a batch: ``buf`` holds them, text i at [offs[i], offs[i+1] - 1)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int):
        self.buf, self.offs, self.first, self.n = buf, offs, first, len(offs) - 1

    def words(self) -> None:
        """Sets starts and ends of all words, and word_offs: text i has words word_offs[i]:word_offs[i+1]."""
        space = IS_SPACE[self.buf]
        before = np.empty(len(space), bool)
        before[:1] = True
        before[1:] = space[:-1]
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(space & ~before)
        self.word_offs = np.searchsorted(self.starts, self.offs)
        self.n_words = np.diff(self.word_offs)

    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)


def runs(texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[Run]:
    """The texts of an Arrow string array, nulls as empty texts, in runs of about run_bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    lengths = np.asarray(pc.binary_length(texts)).astype(np.int64) + 1
    ends = np.cumsum(lengths)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + run_bytes, "right")))
        part = texts.slice(at, to - at).cast(pa.large_binary())
        part = pc.binary_join_element_wise(part, pa.scalar(b"\xff", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        n = int(ends[to - 1] - base)
        start = int(np.frombuffer(part.buffers()[1], np.int64, 1, part.offset * 8)[0])
        buf = np.frombuffer(part.buffers()[2], np.uint8, n, start)
        offs = np.zeros(to - at + 1, np.int64)
        offs[1:] = ends[at:to] - base
        yield Run(buf, offs, at)
        at = to
    del part, buf, offs
    give_back()


def windows(hashes: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` consecutive words inside each text, and the texts' offsets into them."""
    counts = np.maximum(np.diff(offs) - size + 1, 0)
    out_offs = np.zeros(len(offs), np.int64)
    np.cumsum(counts, out=out_offs[1:])
    n = len(hashes) - size + 1
    if n <= 0 or not out_offs[-1]:
        return np.zeros(0, np.uint64), out_offs
    total = hashes[:n] * _SLOT_CODES[0]
    for k in range(1, size):
        total += hashes[k : n + k] * _SLOT_CODES[k]
    keep = spread(offs[:-1], counts)
    return mix(total[keep]), out_offs


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of range(start, start + count) over all pairs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def sum_by(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values[offs[i]:offs[i+1]], zero where empty."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]
