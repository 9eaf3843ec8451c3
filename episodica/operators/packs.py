"""The pack table (which rows make up which pack): made, written, merged, checked and turned into samples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions.tokens import join_ids, shifted, split_ids
from episodica.operators.rows import numbered, uniform
from episodica.sources.shared import exists, read_text, small, write_text


def pack_table(packed: DataFrame, group: list[str], order: list[str], index: str, length: str) -> DataFrame:
    """package_id (gapless, in order of group), package_size, indices (in order) and indices_count."""
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], F.col(index).cast("long").alias("_i"))))
    packs = packed.groupBy(*group).agg(F.sum(length).cast("long").alias("package_size"), F.transform(items, lambda s: s["_i"]).alias("indices"))
    out = numbered(packs, [F.col(c).asc_nulls_first() for c in group], "package_id")
    return out.select("package_id", "package_size", "indices", F.size("indices").alias("indices_count"))


def info(packs: DataFrame) -> DataFrame:
    """One row: packs, items, and sum, average, largest, least and population std of their sizes."""
    size = F.col("package_size")
    return packs.agg(F.count("*").alias("packs"), F.coalesce(F.sum("indices_count"), F.lit(0)).alias("items"), F.coalesce(F.sum(size), F.lit(0)).alias("total"), F.avg(size).alias("average"), F.max(size).alias("largest"), F.min(size).alias("least"), F.stddev_pop(size).alias("std"))


def write_packs(packs: DataFrame, path: str, **about) -> None:
    """Parquet with the ids as text, and a JSON sidecar with info and whatever about says (capacity, seed)."""
    packs.select("package_id", "package_size", join_ids(F.col("indices")).alias("indices_str"), "indices_count").write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/packs.parquet")
    spark = packs.sparkSession
    write_text(spark, json.dumps(info(spark.read.parquet(f"{path}/packs.parquet")).first().asDict() | about), f"{path}/packs.json")


def read_packs(spark, path: str) -> tuple[DataFrame, dict]:
    """The pack table and its sidecar (empty if it isn't there)."""
    found = spark.read.parquet(f"{path}/packs.parquet").select("package_id", "package_size", split_ids(F.col("indices_str")).alias("indices"), "indices_count")
    return found, json.loads(read_text(spark, f"{path}/packs.json")) if exists(spark, f"{path}/packs.json") else {}


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both tables' packs; those of second are numbered on from first's (ids are gapless in each)."""
    return first.unionByName(second.withColumn("package_id", F.col("package_id") + F.lit(first.count())))


def of_packs(packs: DataFrame, ids: list[int]) -> DataFrame:
    return packs.where(F.col("package_id").isin(*ids))


def check(packs: DataFrame) -> DataFrame:
    """One row: whether there is a pack, none is empty, every count is that of its ids, and ids are gapless."""
    whole = F.coalesce(F.min("indices_count") > 0, F.lit(False)) & F.coalesce(F.bool_and(F.size("indices") == F.col("indices_count")), F.lit(False))
    gapless = F.coalesce(F.max("package_id") + 1 == F.count("*"), F.lit(False))
    return packs.agg(F.count("*").alias("packs"), (whole & gapless).alias("sound"))


def complete(packs: DataFrame, short: DataFrame, index: str, first_trajectory: int, seed: int = 42) -> DataFrame:
    """packs, with one short instruction row more where a pack has none (ids below first_trajectory are instructions).

    The row is drawn by the pack's id, the same in every run; the pack may exceed its capacity.  short: rows to draw from."""
    pool = numbered(short.select(F.col(index).cast("long").alias("_extra")), ["_extra"], "_k")
    n = pool.count()
    if not n:
        return packs
    lacks = F.forall("indices", lambda i: i >= first_trajectory)
    drawn = packs.withColumn("_k", F.when(lacks, F.floor(uniform(F.col("package_id"), seed) * n).cast("long")))
    out = drawn.join(small(pool), "_k", "left").withColumn("indices", F.when(F.col("_extra").isNotNull(), F.concat("indices", F.array("_extra"))).otherwise(F.col("indices")))
    return out.withColumn("indices_count", F.size("indices")).drop("_k", "_extra")


def materialise(packs: DataFrame, samples: DataFrame, index: str = "idx") -> DataFrame:
    """Packs as samples: ids, labels and positions of their rows one after the other, seq_lens, and spans moved on to their place.

    samples: idx, ids, labels, positions (arrays of one length) and span (struct or null).  A pack is bounded by its
    capacity, so its rows may meet in one group.  Rows that aren't in samples are left out."""
    places = packs.select("package_id", F.posexplode("indices").alias("_p", index))
    rows = places.join(samples, index).withColumn("_n", F.size("ids"))
    before = Window.partitionBy("package_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))
    item = F.struct("_p", "ids", "labels", "positions", "_n", shifted(F.col("span"), F.col("_at")).alias("span"))
    out = rows.groupBy("package_id").agg(F.array_sort(F.collect_list(item), lambda a, b: a["_p"] - b["_p"]).alias("_i"))
    flat = lambda c: F.flatten(F.transform("_i", lambda s: s[c])).alias(c)
    spans = F.filter(F.transform("_i", lambda s: s["span"]), lambda s: s.isNotNull())
    return out.select("package_id", flat("ids"), flat("labels"), flat("positions"), F.transform("_i", lambda s: s["_n"]).alias("seq_lens"), spans.alias("spans"))
