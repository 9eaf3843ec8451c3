"""Shared helpers: durable cuts, size-checked broadcasts, splitters and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.sources.shared import cut, new_path, shared_dir

#: Rows up to which a narrow table of ids may be broadcast (about 16 bytes each); beyond, a shuffle join is used.
BROADCAST_ROWS = 1_000_000
#: Rows of whole texts in an Arrow batch: what a worker and its executor hold of them at once.
TEXT_BATCH_ROWS = 2000


def write_table(df: DataFrame, name: str) -> DataFrame:
    """As cut, but as compressed Parquet: for wide rows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to TEXT_BATCH_ROWS rows, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_BATCH_ROWS:
        spark.conf.set(name, str(TEXT_BATCH_ROWS))


def unused(name: str, taken: list[str]) -> str:
    """name, with as many _ before it as make it none of taken (in any case of letters)."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def bucket_of(key: Column, splitters: list) -> Column:
    """The number of splitters (ascending) that are <= key, by a two-level search; null keys count as least."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    constant = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  folded to a literal
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    coarse = splitters[step - 1 :: step]
    first = below(constant(coarse)) * step
    return F.coalesce(first + below(F.slice(constant(splitters), first + 1, F.lit(step))), F.lit(0))


#: Edges up to which one task finishes the components (16 bytes each); more are contracted by rounds of joins first.
ONE_TASK_EDGES = 1_000_000


def _least_reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, least id that edges reach) of all nodes of the edges (a, b) of one task."""
    pairs = [np.stack([np.asarray(x.column(0)), np.asarray(x.column(1))]) for x in batches if x.num_rows]
    if not pairs:
        return
    ids, ends = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(ids))
    while (left := root[a] != root[b]).any():
        a, b = a[left], b[left]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "to"])


def components(edges: DataFrame, one_task_edges: int | None = None) -> DataFrame:
    """Connected components of edges (a long, b long): (id, component), component being the least id that links reach.

    Every round each node hooks to its least neighbour and the edges are contracted.  In round r hooks are first followed
    r times by doubling, so that a chain of falling ids, along which a single hook gets one step on, shrinks by 2^r.  Edges
    stay distributed and each round is written, so that the next one is planned by true sizes (a checkpoint keeps the
    plan's estimate, which joins multiply round by round).  Once at most one_task_edges (ONE_TASK_EDGES) are left, one task
    finishes them; the result is the same.  A node with very many edges meets them in partial minima, and its relabelling
    is a join that adaptive execution can split.  Nulls and loops are ignored; without edges the result is empty."""
    bound = ONE_TASK_EDGES if one_task_edges is None else one_task_edges
    e = write_table(edges.select("a", "b").where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    doublings = 0
    while left := e.count():
        if left <= bound:
            hooks = write_table(e.coalesce(1).mapInArrow(_least_reachable, "id long, to long"), "hooks")
        else:
            hooks = write_table(e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")), "hooks")
            for _ in range(doublings):
                further = hooks.select(F.col("id").alias("to"), F.col("to").alias("_next"))
                hooks = write_table(hooks.join(further, "to", "left").select("id", F.coalesce("_next", "to").alias("to")), "hooks")
            doublings += 1
        if labels is None:
            nodes = e.select(F.col("a").alias("id")).union(e.select(F.col("b").alias("id"))).distinct()
            labels = hooks.withColumnRenamed("to", "component") if left <= bound else nodes.join(hooks, "id", "left").select("id", F.coalesce("to", "id").alias("component"))
        else:
            labels = labels.join(hooks.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = write_table(labels, "labels")
        if left <= bound:
            return labels
        for side in ("a", "b"):
            e = e.join(hooks.withColumnRenamed("id", side), side, "left").select(*[F.coalesce("to", side).alias(side) if c == side else F.col(c) for c in ("a", "b")])
        e = write_table(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.sparkSession.createDataFrame([], "id long, component long")


__all__ = ["BROADCAST_ROWS", "TEXT_BATCH_ROWS", "bound_batches", "bucket_of", "components", "cut", "new_path", "shared_dir", "unused", "write_table"]
