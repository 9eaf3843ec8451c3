"""Frames of episodes and fixed-length chunks that start at each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.operators.rows import BLOCK_ROWS, apart, hot_keys, numbered
from episodica.sources.shared import small


#: Looks hot episodes up itself; else what rows.hot_keys found for the same rows.
LOOK = "look"


def frames(df: DataFrame, episode: str, order: list[str], hot: DataFrame | str | None = LOOK) -> DataFrame:
    """Adds frame_index (0-based in the episode), steps_to_go (0 on the last frame) and episode_length.

    One shuffle by episode serves all three; frames of hot episodes are numbered by range partitions instead, so that no task
    holds a whole one.  order must be unique inside an episode."""
    hot = hot_keys(df, episode) if hot is LOOK else hot
    rest, crowded = (df, None) if hot is None else apart(df, episode, hot)
    by = Window.partitionBy(episode)
    index = F.row_number().over(by.orderBy(*order)) - 1
    out = rest.withColumn("frame_index", index.cast("long")).withColumn("episode_length", F.count("*").over(by))
    if crowded is not None:
        placed = numbered(crowded, [F.col(episode).asc_nulls_first(), *order], "_place")
        ends = small(placed.groupBy(F.col(episode).alias("_key")).agg(F.min("_place").alias("_low"), F.count("*").alias("episode_length")))
        placed = placed.join(ends, placed[episode].eqNullSafe(ends["_key"])).withColumn("frame_index", F.col("_place") - F.col("_low"))
        out = out.unionByName(placed.drop("_key", "_low", "_place"))
    return out.withColumn("steps_to_go", F.col("episode_length") - 1 - F.col("frame_index"))


def chunk(df: DataFrame, value: str | Column, horizon: int, episode: str = "episode_index", frame: str | list[str] = "frame_index", name: str = "chunk", hot: DataFrame | str | None = LOOK) -> DataFrame:
    """Adds the values of the horizon frames from each frame on; the episode's last value fills the rest, and {name}_is_pad marks it.

    The other parameters are those of ahead()."""
    out = ahead(df, value, horizon, episode, frame, "_c", hot)
    real = F.size("_c")
    values = F.transform(F.concat("_c", F.array_repeat(F.element_at("_c", -1), F.lit(horizon) - real)), lambda s: s["v"])
    pad = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: i >= real)
    return out.withColumn(name, values).withColumn(f"{name}_is_pad", pad).drop("_c")


def ahead(df: DataFrame, value: str | Column, horizon: int, episode: str = "episode_index", frame: str | list[str] = "frame_index", name: str = "ahead", hot: DataFrame | str | None = LOOK) -> DataFrame:
    """Adds an array of struct(v), the values of the next horizon frames that there are, from each frame on.

    frame: what orders an episode; the columns that frames() was given spare a second sort.  The frames of hot episodes go to
    blocks in order, with the horizon - 1 frames after each block besides."""
    order = [frame] if isinstance(frame, str) else frame
    column = F.col(value) if isinstance(value, str) else value
    hot = hot_keys(df, episode) if hot is LOOK else hot
    rest, crowded = (df, None) if hot is None else apart(df, episode, hot)
    onward = Window.partitionBy(episode).orderBy(*order).rowsBetween(0, horizon - 1)
    out = rest.withColumn(name, F.collect_list(F.struct(column.alias("v"))).over(onward))
    if crowded is not None:
        placed = numbered(crowded.withColumn("_s", F.struct(column.alias("v"))), [F.col(episode).asc_nulls_first(), *order], "_place")
        block = lambda c: F.floor(c / F.lit(BLOCK_ROWS)).cast("long")
        dealt = placed.withColumn("_block", F.explode(F.sequence(block(F.greatest(F.col("_place") - (horizon - 1), F.lit(0))), block(F.col("_place")))))
        onward = Window.partitionBy("_block").orderBy("_place").rowsBetween(0, horizon - 1)
        dealt = dealt.withColumn("_c", F.collect_list(F.struct(F.col(episode).alias("k"), F.col("_s").alias("s"))).over(onward)).where(F.col("_block") == block(F.col("_place")))
        same = F.filter("_c", lambda x: x["k"].eqNullSafe(F.col(episode)))
        dealt = dealt.withColumn(name, F.transform(same, lambda x: x["s"]))
        out = out.unionByName(dealt.drop("_s", "_block", "_place", *({"_c"} - {name})))
    return out


def chunk_rows(df: DataFrame, name: str = "chunk") -> DataFrame:
    """A row for each step of each chunk: delta, value, is_pad instead of the arrays."""
    rows = df.select("*", F.posexplode(F.arrays_zip(F.col(name).alias("value"), F.col(f"{name}_is_pad").alias("is_pad"))).alias("delta", "_s"))
    return rows.withColumn("value", F.col("_s.value")).withColumn("is_pad", F.col("_s.is_pad")).drop("_s", name, f"{name}_is_pad")
