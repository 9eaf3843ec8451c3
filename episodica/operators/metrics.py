"""Aggregates over metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channel_loss(df: DataFrame, key: str, loss: str | Column, count: str | Column) -> DataFrame:
    """Sum of losses over sum of counts by key, to 4 places; keys without counts are left out."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = df.groupBy(key).agg(F.sum(col(loss)).alias("_l"), F.sum(col(count)).alias("loss_count")).where("loss_count > 0")
    return out.select(key, F.round(F.col("_l") / F.col("loss_count"), 4).alias("loss"), "loss_count")


def masked_mean(value: Column, valid: Column) -> Column:
    """Mean of value where valid, 0 where nothing is."""
    return F.coalesce(F.avg(F.when(valid, value)), F.lit(0.0))


def success_rate(df: DataFrame, task: str, success: Column) -> DataFrame:
    """Episodes and success rate by task, and of all in the row whose task is null."""
    return df.withColumn("_s", success.cast("double")).rollup(task).agg(F.count("*").alias("episodes"), F.avg("_s").alias("rate"))


def timing(df: DataFrame, rank: str, seconds: str | Column, name: str) -> DataFrame:
    """Average, largest and least over ranks of each rank's mean seconds, to 4 places, by name."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    by_rank = df.groupBy(name, rank).agg(F.avg(s).alias("_m"))
    return by_rank.groupBy(name).agg(F.round(F.avg("_m"), 4).alias("avg_s"), F.round(F.max("_m"), 4).alias("max_s"), F.round(F.min("_m"), 4).alias("min_s"))


def length_estimate(df: DataFrame, group: str, order: str, length: str | Column) -> DataFrame:
    """Half the sum of a group's first and last length, cut to an int."""
    n = F.col(length) if isinstance(length, str) else length
    return df.groupBy(group).agg(F.floor((F.min_by(n, order) + F.max_by(n, order)) / 2).cast("long").alias("estimate"))


def flow_loss(df: DataFrame, predicted: str, target: str, is_pad: str, dof_mask: str) -> DataFrame:
    """One row: squared error over the first valid dims of all steps that aren't padding, divided by those steps times dims.

    predicted, target: array (steps) of arrays (dims); is_pad: array of booleans; dof_mask: array (steps) of arrays of 0 or 1.
    The valid dims are those that the mask of the first row's first step counts, as rows of a batch have one embodiment; the
    first row is the one of least order in the table's column _order."""
    dims = F.min_by(F.aggregate(F.col(dof_mask)[0], F.lit(0), lambda s, x: s + x.cast("int")), "_order")
    steps = df.crossJoin(F.broadcast(df.agg(dims.alias("_dims"))))  # one row on the right
    steps = steps.select("_dims", F.explode(F.arrays_zip(F.col(predicted).alias("p"), F.col(target).alias("t"), F.col(is_pad).alias("pad"))).alias("s")).where(~F.col("s.pad"))
    error = F.aggregate(F.zip_with(F.slice("s.p", F.lit(1), F.col("_dims")), F.slice("s.t", F.lit(1), F.col("_dims")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return steps.agg((F.sum(error) / (F.count("*") * F.max("_dims"))).alias("loss"), F.count("*").alias("steps"))


def token_losses(df: DataFrame, labels: str, losses: str, guesses: str, first_action: int, ignore: int = -100) -> DataFrame:
    """One row: mean loss over labels that count (0 without any), and the share of right guesses of action tokens (null without any).

    losses and guesses belong to the token before each label, so labels are shifted by one."""
    shifted = F.arrays_zip(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))).alias("y"), F.slice(losses, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))).alias("loss"), F.slice(guesses, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))).alias("guess"))
    rows = df.select(F.explode(shifted).alias("s")).select("s.*")
    return rows.agg(masked_mean(F.col("loss"), F.col("y") != ignore).alias("loss"), F.avg(F.when(F.col("y") >= first_action, (F.col("guess") == F.col("y")).cast("double"))).alias("action_accuracy"))


def filled_lengths(df: DataFrame, known: str, computed: Column) -> DataFrame:
    """Adds length: the known number of tokens, else the computed one."""
    return df.withColumn("length", F.coalesce(F.col(known).cast("long"), computed.cast("long")))


def meta_loss(df: DataFrame, name: str, rank: str, loss: str, accumulation: int, steps: int) -> DataFrame:
    """By name: sums of losses over accumulation steps by rank, averaged over ranks, by step, to 4 places."""
    by_rank = df.groupBy(name, rank).agg((F.sum(loss) / accumulation).alias("_s"))
    return by_rank.groupBy(name).agg(F.round(F.avg("_s") / steps, 4).alias("loss"))


def append_log(rows: DataFrame, path: str) -> DataFrame:
    """Appends metric rows to the table at path; the whole table."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def report(rates: DataFrame, task: str) -> DataFrame:
    """Lines of text: episodes and success rate in per cent by task, the total (null task) last."""
    name = F.coalesce(F.col(task), F.lit("total"))
    line = F.concat(name, F.lit(": "), F.col("episodes").cast("string"), F.lit(" episodes, "), F.round(F.col("rate") * 100, 1).cast("string"), F.lit(" %"))
    return rates.select(F.col(task).isNull().alias("is_total"), line.alias("value"))
