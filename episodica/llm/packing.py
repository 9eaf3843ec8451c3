"""Packing tokenised documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import cut
from episodica.llm.encoding import encoder
from episodica.llm.textbytes import runs

CAPACITY = 4096
#: Pieces that one differencing run takes; groups are formed by hash and packed independently.
GROUP_ROWS = 2048
#: Groups that one task packs at most: its rows are held at once (about 10 MB).
GROUPS = 64
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each size: multiway differencing for near-equal sums.

    A heap holds partial partitions into k windows by their imbalance (largest less smallest sum).  The two most imbalanced
    are merged with opposing imbalances, the largest window of one with the smallest of the other, until one is left."""
    n = len(sizes)
    if n <= k:
        return np.arange(n)
    after = np.full(n, -1, np.int64)  # the next item of the same window
    empty = np.full(k, -1, np.int64)
    heap: list[tuple[int, int, tuple | None]] = [(-int(s), i, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def full(entry):
        if entry[2] is not None:
            return entry[2]
        sums, head = np.zeros(k, np.int64), empty.copy()
        sums[0], head[0] = sizes[entry[1]], entry[1]
        return sums, head, head.copy()

    while len(heap) > 1:
        one, two = heapq.heappop(heap), heapq.heappop(heap)
        (sums, head, tail), (sums2, head2, tail2) = full(one), full(two)
        head2, tail2 = head2[::-1], tail2[::-1]
        total = sums + sums2[::-1]
        both = np.flatnonzero((head >= 0) & (head2 >= 0))
        after[tail[both]] = head2[both]
        new_head, new_tail = np.where(head >= 0, head, head2), np.where(tail2 >= 0, tail2, tail)
        order = np.argsort(-total, kind="stable")
        total = total[order]
        heapq.heappush(heap, (int(total[-1] - total[0]), one[1], (total, new_head[order], new_tail[order])))
    out = np.empty(n, np.int64)
    for window, item in enumerate(heap[0][2][1].tolist()):
        while item >= 0:
            out[item] = window
            item = after[item]
    return out


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Windows of sizes (each at most capacity), none above capacity: the window count rises whenever one exceeds it."""
    k = max(1, -(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    while len(sizes):
        windows = differencing(sizes, k)
        if np.bincount(windows, sizes).max() <= capacity:
            return windows
        k += max(1, k // 400)
    return np.zeros(0, np.int64)


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for run in runs(batch.column(1)):
                ids, offs = enc.run(run)
                ids, out = ids.astype("<u4"), [[], [], [], [], []]
                for key, a, b in zip(keys[run.first : run.first + run.n], offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    for at in range(a, b, capacity):
                        to = min(at + capacity, b)
                        for column, x in zip(out, (key, at - a, to - at, zlib.crc32(ids[at:to]), b - a), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

    return cut_texts


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cuts every whole text's ids (null: empty), followed by end_id, at multiples of capacity: a row for each piece."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pieces(tokenizer, end_id, capacity), PIECE)


def _place(capacity: int, schema: pa.Schema):
    """sequence_id and offset of the pieces of a task's groups, each group packed for itself."""

    def place(group: pa.Table) -> pa.Table:
        sizes = np.asarray(group["length"]).astype(np.int64)
        windows = pack_sizes(sizes, capacity)
        order = np.argsort(windows, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.flatnonzero(np.diff(windows[order], prepend=-1))
        base = np.repeat((ends - sizes[order])[first], np.diff(np.append(first, len(order))))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - base
        sequence = (np.asarray(group["_group"]).astype(np.int64) << 20 | windows) << 1 | 1
        return group.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema)  # a bounded number of narrow rows: see GROUPS
        group = np.asarray(rows["_group"])
        order = np.argsort(group, kind="stable")
        rows, group = rows.take(pa.array(order)), group[order]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=False):
            yield from place(rows.slice(a, b - a).combine_chunks()).to_batches()

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0 in each sequence) to pieces (length at most capacity, at least 1).

    Pieces of full capacity are sequences of their own; the rest goes by hash into groups of about group_rows rows, each
    packed by differencing.  Equal rows are told apart by their place, so they spread over groups.  sequence_id is unique
    but not gapless.  Lengths above capacity raise.  Without rows the result is empty."""
    rows = cut(rows).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_row", F.when(F.col("length") <= capacity, F.col("_row")).otherwise(F.raise_error(F.lit("a piece is longer than a sequence"))))
    full = rows.where(F.col("length") == capacity).withColumn("sequence_id", F.col("_row") * 2).withColumn("offset", F.lit(0).cast("long")).drop("_row")
    rest = rows.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_rows))
    rest = rest.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int")).drop("_row")
    # the work is CPU, which sizes in bytes don't show: groups are dealt evenly to a set number of tasks
    tasks = max(min(groups, 2 * rows.sparkSession.sparkContext.defaultParallelism), -(-groups // GROUPS))
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([(n, kinds[t]) for n, t in rest.dtypes])
    out = ", ".join(f"`{n}` {t}" for n, t in rest.drop("_group").dtypes) + ", sequence_id long, offset long"
    dealt = rest.repartitionById(tasks, F.pmod(F.col("_group"), F.lit(tasks)))
    return full.unionByName(dealt.mapInArrow(_place(capacity, schema), out))
