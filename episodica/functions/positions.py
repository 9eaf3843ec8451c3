"""Positions of token rows in three axes: as rows for each token (tables), or as column expressions (short rows).

A column expression inside a lambda is evaluated anew for every element, so the functions for tables first put every array
into a column of its own (see fixed), place blocks by prefix sums, and then make the tokens' rows block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block(text: Column, t: Column, h: Column, w: Column, step: Column | None = None) -> Column:
    """A stretch of text tokens and the media block after it, of grid (t, h, w); t 0 stands for no media.

    step: positions that the time axis moves on from one time of the grid to the next."""
    return F.struct(text.cast("int").alias("text"), t.cast("int").alias("t"), h.cast("int").alias("h"), w.cast("int").alias("w"), (F.lit(1.0) if step is None else step.cast("double")).alias("step"))


def positions(blocks: Column, merge: int = 2) -> Column:
    """array of struct(t, h, w) for the tokens of an array of blocks.

    Text counts up alike in all three axes; a media block runs over (t * step cut to an int, h / merge, w / merge) from the
    position that text had reached, and text goes on after the largest position so far."""
    high = lambda b: F.floor(b["h"] / F.lit(merge)).cast("int")
    wide = lambda b: F.floor(b["w"] / F.lit(merge)).cast("int")
    last = lambda b: F.floor((b["t"] - 1) * b["step"]).cast("int") + 1
    extent = lambda b: F.when(b["t"] > 0, F.greatest(last(b), high(b), wide(b))).otherwise(0)
    start = F.struct(F.array().cast("array<int>").alias("bases"), F.lit(0).alias("base"))
    step = lambda s, b: F.struct(F.concat(s["bases"], F.array(s["base"])).alias("bases"), (s["base"] + b["text"] + extent(b)).alias("base"))
    bases = F.aggregate(blocks, start, step, lambda s: s["bases"])
    point = lambda t, h, w: F.struct(t.cast("int").alias("t"), h.cast("int").alias("h"), w.cast("int").alias("w"))
    none = F.array().cast("array<struct<t:int,h:int,w:int>>")

    def tokens(b, base):
        text = F.when(b["text"] > 0, F.transform(F.sequence(F.lit(0), b["text"] - 1), lambda i: point(base + i, base + i, base + i))).otherwise(none)
        at, area = base + b["text"], high(b) * wide(b)
        media = F.transform(F.sequence(F.lit(0), b["t"] * area - 1), lambda i: point(at + F.floor(F.floor(i / area) * b["step"]), at + F.floor(F.pmod(i, area) / wide(b)), at + F.pmod(i, wide(b))))
        return F.concat(text, F.when((b["t"] > 0) & (area > 0), media).otherwise(none))

    return F.flatten(F.zip_with(blocks, bases, tokens))


def blocks_of(ids: Column, grids: Column, image: int, video: int, start: int, merge: int = 2) -> Column:
    """Blocks of a token row: media begin behind a start token with an image or video token; grids: array of struct(t, h, w, step) in their order."""
    at = lambda i: F.get(ids, i)
    begins = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))), lambda i: F.when((at(i - 1) == start) & at(i).isin(image, video), i)), lambda i: i.isNotNull())
    size = lambda g: g["t"] * F.floor(g["h"] / F.lit(merge)).cast("int") * F.floor(g["w"] / F.lit(merge)).cast("int")
    media = F.zip_with(begins, F.slice(grids, F.lit(1), F.size(begins)), lambda i, g: F.struct(i.alias("at"), g.alias("g")))
    ends = F.concat(F.array(F.lit(0)), F.transform(media, lambda m: m["at"] + size(m["g"])))
    found = F.zip_with(media, F.slice(ends, F.lit(1), F.size(begins)), lambda m, end: block(m["at"] - end, m["g"]["t"], m["g"]["h"], m["g"]["w"], m["g"]["step"]))
    rest = F.size(ids) - F.element_at(ends, -1)
    return F.concat(found, F.array(block(rest, F.lit(0), F.lit(0), F.lit(0))))


def frames_of_video(grid: Column) -> Column:
    """The grids of a video's frames, each with one time."""
    return F.transform(F.sequence(F.lit(1), grid["t"]), lambda i: F.struct(F.lit(1).alias("t"), grid["h"].alias("h"), grid["w"].alias("w"), F.lit(1.0).alias("step")))


def delta(found: Column, length: Column) -> Column:
    """Largest position plus 1, less the row's length."""
    return F.aggregate(found, F.lit(-1), lambda s, p: F.greatest(s, p["t"], p["h"], p["w"])) + 1 - length


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row, whatever expressions read them: no later step is merged with them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_blocks(df: DataFrame, ids: Column, grids: Column, image: int, video: int, start: int, merge: int = 2) -> DataFrame:
    """Adds _blocks, those of blocks_of, for rows of any length."""
    size = lambda g: g["t"] * F.floor(g["h"] / F.lit(merge)).cast("int") * F.floor(g["w"] / F.lit(merge)).cast("int")
    df = fixed(df, _ids=ids, _grids=grids)
    begins = F.filter(F.transform("_ids", lambda x, i: F.when((i > 0) & x.isin(image, video) & (F.get("_ids", i - 1) == start), i)), lambda i: i.isNotNull())
    df = fixed(df, _begins=begins)
    df = fixed(df, _media=F.zip_with("_begins", F.slice("_grids", F.lit(1), F.size("_begins")), lambda i, g: F.struct(i.alias("at"), g.alias("g"))))
    df = fixed(df, _ends=F.concat(F.array(F.lit(0)), F.transform("_media", lambda m: m["at"] + size(m["g"]))))
    found = F.zip_with("_media", F.slice("_ends", F.lit(1), F.size("_begins")), lambda m, end: block(m["at"] - end, m["g"]["t"], m["g"]["h"], m["g"]["w"], m["g"]["step"]))
    rest = F.size("_ids") - F.element_at("_ends", -1)
    df = fixed(df, _blocks=F.concat(found, F.array(block(rest, F.lit(0), F.lit(0), F.lit(0)))))
    return df.drop("_ids", "_grids", "_begins", "_media", "_ends")


def position_rows(df: DataFrame, key: list[str], blocks: str = "_blocks", merge: int = 2) -> DataFrame:
    """key (which must tell rows apart), n (0-based place of the token), t, h and w: a row for each token of an array of blocks, as
    positions() has them.  Where blocks begin, and which token is their first, are prefix sums over the blocks of a row."""
    parts = df.select(*key, F.posexplode(blocks).alias("_k", "_b")).select(*key, "_k", "_b.*")
    high, wide = (F.floor(F.col(c) / F.lit(merge)).cast("int") for c in ("h", "w"))
    parts = parts.withColumns({"h": F.when(F.col("t") > 0, high).otherwise(0), "w": F.when(F.col("t") > 0, wide).otherwise(0)})
    parts = parts.withColumn("_media", F.col("t") * F.col("h") * F.col("w"))
    extent = F.when(F.col("t") > 0, F.greatest(F.floor((F.col("t") - 1) * F.col("step")).cast("int") + 1, F.col("h"), F.col("w"))).otherwise(0)
    before = Window.partitionBy(*key).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({"_base": F.coalesce(F.sum(F.col("text") + extent).over(before), F.lit(0)), "_first": F.coalesce(F.sum(F.col("text") + F.col("_media")).over(before), F.lit(0))})
    n = F.col("text") + F.col("_media")
    tokens = placed.where(n > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    is_text, j = F.col("_i") < F.col("text"), F.col("_i") - F.col("text")
    text, at = F.col("_base") + F.col("_i"), F.col("_base") + F.col("text")
    time = at + F.floor(F.floor(j / (F.col("h") * F.col("w"))) * F.col("step"))
    axes = {"t": time, "h": at + F.floor(F.pmod(j, F.col("h") * F.col("w")) / F.col("w")), "w": at + F.pmod(j, F.col("w"))}
    return tokens.select(*key, (F.col("_first") + F.col("_i")).alias("n"), *[F.when(is_text, text).otherwise(x).cast("long").alias(c) for c, x in axes.items()])


def text_position_rows(df: DataFrame, key: list[str], mask: Column) -> DataFrame:
    """key (which must tell rows apart), i and position: as text_positions(), a row for each token, by a prefix sum."""
    tokens = df.select(*key, F.posexplode(mask).alias("i", "_m"))
    before = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    real = F.coalesce(F.sum(F.col("_m").cast("long")).over(before), F.lit(0))
    return tokens.select(*key, "i", F.when(F.col("_m") == 0, F.lit(1).cast("long")).otherwise(real).alias("position"))


def text_positions(mask: Column) -> Column:
    """Positions of a row without media: the number of real tokens before each; 1 where the mask is 0."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n"))
    step = lambda s, m: F.struct(F.concat(s["out"], F.array(F.when(m == 0, F.lit(1)).otherwise(s["n"]))).alias("out"), (s["n"] + m.cast("int")).alias("n"))
    return F.aggregate(mask, start, step, lambda s: s["out"])
