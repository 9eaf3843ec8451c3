"""Token-id files of directly addressable codes.

An id is split into chunks of 12, 4, 8 and 8 bits.  Level 0 holds the first chunk of every id; a continuation bitmap says
which ids go on, and level 1 holds the next chunk of those only, and so on.  A rank directory over each bitmap gives the
place of an id's next chunk by one lookup and a short popcount, so any id or range of ids is read without decoding what
stands before it.  Files are Parquet rows of segments (some whole documents each), in ascending doc_id order over all
parts: part p precedes part p + 1, and segments and documents are in order within a part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.llm.common import new_path
from episodica.llm.encoding import encoder
from episodica.llm.textbytes import runs
from episodica.sources.shared import small

WIDTHS = (12, 4, 8, 8)
#: Bits of a bitmap for each entry of its rank directory.
STRIDE = 512
#: Ids that a segment gathers before it is closed.
SEGMENT_IDS = 1 << 20
SEGMENT = "part int, segment int, start long, doc_ids array<long>, ends array<long>, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
_SEGMENT = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("chunks", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def _pack(values: np.ndarray, width: int) -> bytes:
    """8 bits: a byte each; 4 bits: two to a byte; 12 bits: a byte each, then two to a byte."""
    out = values.astype(np.uint8).tobytes() if width >= 8 else b""
    if width % 8:
        high = (values >> (width - 4)).astype(np.uint8) & 15
        if len(high) % 2:
            high = np.append(high, np.uint8(0))
        out += (high[0::2] | high[1::2] << 4).tobytes()
    return out


def _unpack(data: bytes, n: int, width: int, a: int, b: int) -> np.ndarray:
    """Values a to b (exclusive) of the n packed ones."""
    raw = np.frombuffer(data, np.uint8)
    values = raw[a:b].astype(np.uint32) if width >= 8 else np.zeros(b - a, np.uint32)
    if width % 8:
        base = n if width > 8 else 0
        pairs = raw[base + a // 2 : base + (b + 1) // 2]
        both = np.empty(2 * len(pairs), np.uint32)
        both[0::2], both[1::2] = pairs & 15, pairs >> 4
        values |= both[a % 2 : a % 2 + b - a] << np.uint32(width - 4)
    return values


def encode_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of the levels that are needed."""
    chunks, bitmaps, ranks, rest = [], [], [], ids.astype(np.uint32)
    for width in WIDTHS:
        chunks.append(_pack(rest & np.uint32((1 << width) - 1), width))
        rest = rest >> np.uint32(width)
        goes_on = rest > 0
        if not goes_on.any():
            break
        bitmaps.append(np.packbits(goes_on, bitorder="little").tobytes())
        sums = np.add.reduceat(goes_on, np.arange(0, len(goes_on), STRIDE), dtype=np.uint32)
        ranks.append(np.concatenate([[0], np.cumsum(sums)]).astype("<u4").tobytes())
        rest = rest[goes_on]
    return chunks, bitmaps, ranks


def _rank(bitmap: np.ndarray, rank: np.ndarray, i: int) -> int:
    """Set bits before bit i."""
    at = i // STRIDE * STRIDE
    return int(rank[i // STRIDE]) + int(np.unpackbits(bitmap[at // 8 : (i + 7) // 8], bitorder="little")[: i - at].sum())


def read_range(segment: dict, a: int, b: int, level: int = 0) -> np.ndarray:
    """Ids a to b (exclusive) of a segment, reading only their chunks."""
    n = segment["ends"][-1] if level == 0 and len(segment["ends"]) else 0
    if level:
        n = int(np.frombuffer(segment["ranks"][level - 1], "<u4")[-1])
    values = _unpack(segment["chunks"][level], n, WIDTHS[level], a, b)
    if level < len(segment["bitmaps"]) and b > a:
        bitmap, rank = np.frombuffer(segment["bitmaps"][level], np.uint8), np.frombuffer(segment["ranks"][level], "<u4")
        bits = np.unpackbits(bitmap[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        go_on = np.flatnonzero(bits)
        if len(go_on):
            first = _rank(bitmap, rank, a)
            values[go_on] |= read_range(segment, first, first + len(go_on), level + 1) << np.uint32(WIDTHS[level])
    return values


def _segments(tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        enc, docs, parts, ends, size = encoder(tokenizer, end_id), [], [], [], 0

        def close() -> pa.RecordBatch:
            chunks, bitmaps, ranks = encode_levels(np.concatenate(parts))
            row = [[part], [segment], [start], [docs], [ends], [chunks], [bitmaps], [ranks]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _SEGMENT, strict=True)], schema=_SEGMENT)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for run in runs(batch.column(1)):
                ids, offs = enc.run(run)
                docs += keys[run.first : run.first + run.n]
                ends += (offs[1:] + size).tolist()
                parts.append(ids)
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield close()
                    segment, start = segment + 1, start + size
                    docs, parts, ends, size = [], [], [], 0
        if docs:
            yield close()

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every whole text (null: empty), each followed by end_id, to files at path, in ascending key order.

    One shuffle brings the texts into ranges of key and hash of even row counts; each range is sorted, encoded and written by its
    task, so that rows of one key, or of none, spread as well.  Null keys come first; rows with one key are ordered by a hash of
    their texts.  Without rows no segment is written."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_hash"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    rows = rows.repartitionByRange(max(1, docs.rdd.getNumPartitions()), *order).sortWithinPartitions(*order).drop("_hash")
    rows.mapInArrow(_segments(tokenizer, end_id), SEGMENT).write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for row in range(batch.num_rows):
            segment = {c: batch.column(c)[row].as_py() for c in ("part", "start", "doc_ids", "ends", "chunks", "bitmaps", "ranks")}
            ends = np.array(segment["ends"], np.int64)
            ids = read_range(segment, 0, int(ends[-1])).astype("<u4")
            starts = np.concatenate([[0], ends[:-1]])
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [np.full(len(ends), segment["part"], np.int32), segment["doc_ids"], starts + segment["start"], ends - starts, crcs]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files at path, a row for each document: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of its ids as little-endian 32-bit integers)."""
    files = spark.read.schema(SEGMENT).parquet(path)
    sizes = files.groupBy("part").agg(F.sum(F.element_at("ends", -1)).alias("n"))  # a row for each written part
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("_offset"))
    rows = files.mapInArrow(_documents, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(small(offsets), "part").select("doc_id", (F.col("start") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32")


def token_documents(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes docs to a new file set in the shared folder and reads it back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
