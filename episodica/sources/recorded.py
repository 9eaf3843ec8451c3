"""Recorded batches: the first ones of a table, dealt to ranks, written once and replayed in a seeded order."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators.rows import numbered, shuffled
from episodica.sources.shared import exists


def record(df: DataFrame, path: str, order: list[str], batch_rows: int, ranks: int, steps: int | None = None) -> None:
    """Writes the rows of df in order as batches of batch_rows rows: batch k is step k / ranks of rank k % ranks.

    steps: how many batches of each rank are kept (None: all).  Each rank's batches lie in files of their own (rank=R under path),
    with step and place (in the batch) beside the columns; older ones under path are replaced."""
    rows = numbered(df, [F.col(c).asc_nulls_first() for c in order], "_place")
    batch = F.floor(F.col("_place") / F.lit(batch_rows)).cast("long")
    rows = rows.withColumns({"rank": (batch % ranks).cast("int"), "step": F.floor(batch / F.lit(ranks)).cast("long"), "place": (F.col("_place") % batch_rows).cast("long")})
    if steps is not None:
        rows = rows.where(F.col("step") < steps)
    rows.drop("_place").write.mode("overwrite").partitionBy("rank").parquet(path)


def replay(spark: SparkSession, path: str, rank: int, seed: int = 0, epoch: int = 0, done: int = 0) -> DataFrame | None:
    """A rank's recorded batches with turn, their place in this epoch's order; the first done turns are left out, to go on after a stop.

    The order is by md5 of seed, epoch and step, the same on every run.  Without files for the rank there is a warning and None."""
    where = f"{path}/rank={rank}"
    if not exists(spark, where):
        warnings.warn(f"no recorded batches at {where}", stacklevel=2)
        return None
    rows = spark.read.parquet(where)
    steps = numbered(rows.select("step").distinct().withColumn("_epoch", F.lit(epoch)), [*shuffled(["_epoch", "step"], seed), "step"], "turn").select("step", "turn")
    return rows.join(steps.where(F.col("turn") >= done), "step")
