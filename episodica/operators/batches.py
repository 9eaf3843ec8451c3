"""Batches of samples: packed one after the other, or padded to a common length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions.tokens import IGNORE, shifted


def flat_batch(samples: DataFrame, batch: str, order: str) -> DataFrame:
    """A row for each batch: ids, labels and positions of its samples one after the other, bounds (0 and the running sums of
    all their seq_lens), max_seqlen (0 without any) and spans moved on by the lengths of the samples before.

    samples: batch, order, ids, labels, positions, seq_lens, spans.  A batch is as many samples as its maker put into it."""
    before = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = samples.withColumn("_at", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).cast("long"))
    rows = rows.withColumn("spans", F.transform("spans", lambda s: shifted(s, F.col("_at"))))
    # running sums: over the samples before by a window, inside a sample over its few sequences
    total = F.aggregate("seq_lens", F.lit(0).cast("long"), lambda s, n: s + n)
    rows = rows.withColumn("_sum", total).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long"))
    upto = F.aggregate("seq_lens", F.array().cast("array<long>"), lambda s, n: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.col("_base")) + n)))
    rows = rows.withColumn("_upto", upto)
    item = F.struct(F.col(order).alias("_o"), "ids", "labels", "positions", "seq_lens", "spans", "_upto")
    out = rows.groupBy(batch).agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)).alias("_i"))
    flat = lambda c: F.flatten(F.transform("_i", lambda s: s[c]))
    out = out.select(batch, *[flat(c).alias(c) for c in ("ids", "labels", "positions", "seq_lens", "spans", "_upto")])
    sums = F.concat(F.array(F.lit(0).cast("long")), "_upto")
    return out.withColumns({"bounds": sums, "max_seqlen": F.coalesce(F.array_max("seq_lens"), F.lit(0)).cast("long")}).drop("seq_lens", "_upto")


def padded_batch(samples: DataFrame, batch: str, pad: int) -> DataFrame:
    """samples with ids, labels and positions filled up on the right to the batch's longest, by pad, the ignored label and 1; mask
    is where ids aren't pad (so a real pad id is masked too)."""
    rows = samples.withColumn("_n", F.max(F.size("ids")).over(Window.partitionBy(batch)))
    fill = lambda c, x: F.concat(F.col(c), F.array_repeat(F.lit(x).cast("long"), F.col("_n") - F.size(c)))
    rows = rows.withColumns({"ids": fill("ids", pad), "labels": fill("labels", IGNORE), "positions": fill("positions", 1)})
    return rows.withColumn("mask", F.transform("ids", lambda x: x != pad)).drop("_n")


def max_frame_tokens(grids: Column) -> Column:
    """The most h * w of an array of grids (t, h, w) that have a time."""
    return F.array_max(F.transform(F.filter(grids, lambda g: g["t"] > 0), lambda g: g["h"] * g["w"]))
