"""Instruction records in JSON arrays or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions import text as T

SCHEMA = "conversations array<struct<`from`: string, value: string>>, image string, video string, num_tokens int, seq_length int"


def read_instructions(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """Records of a .json (array) or .jsonl file; image and video become arrays of paths, null where absent.

    place: adds a column of that name, whose order is that of the records in the file (or of a folder's files by name), however it
    is split among tasks.  Its values aren't the same on every reading: number them (rows.numbered)."""
    if not path.endswith((".json", ".jsonl")):
        raise ValueError(f"{path} is neither .json nor .jsonl")
    df = spark.read.schema(SCHEMA).json(path, multiLine=path.endswith(".json"))
    media = lambda c: F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).when(F.col(c).isNotNull(), F.array(c)).alias(c)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place")
    return df.select("conversations", media("image"), media("video"), "num_tokens", "seq_length", *([at] if place else []))


def turns(df: DataFrame) -> DataFrame:
    """Adds turns: (role, content) with media and action tags rewritten; only video tags where a record has a video."""
    def content(c):
        seen = F.when(F.col("video").isNotNull(), T.rewrite_tag(c["value"], "video")).otherwise(T.rewrite_tag(c["value"], "image"))
        return F.struct(T.role(c["from"]).alias("role"), T.rewrite_tag(seen, "action", T.ACTION).alias("content"))

    return df.withColumn("turns", F.transform("conversations", content))


def media_paths(df: DataFrame, base: str | None) -> DataFrame:
    """Adds media: image paths, else video paths, with base before those that aren't urls."""
    full = lambda p: F.when(p.startswith("http") | F.lit(base is None), p).otherwise(F.concat_ws("/", F.lit(base), p))
    return df.withColumn("media", F.transform(F.coalesce("image", "video"), full))
