"""Column expressions on instruction texts and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

VISION = "<|vision_start|><|image_pad|><|vision_end|>"
ACTION = "<|action_pad|>"


def canonical(text: Column) -> Column:
    """Lower case, stripped, without its last dots, first letter upper, one dot."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", ""), r"\.+$", "")
    return F.concat(F.upper(F.substring(bare, 1, 1)), bare.substr(F.lit(2), F.length(bare)), F.lit("."))


def rewrite_tag(text: Column, tag: str = "image", token: str = VISION) -> Column:
    """<tag>, the white space before it and one line end after it become the token."""
    return F.regexp_replace(text, rf"(?U)\s*<{tag}>\n?", token.replace("\\", "\\\\").replace("$", "\\$"))


def role(name: Column) -> Column:
    return F.when(name == "human", "user").when(name == "gpt", "assistant").otherwise(name)


def camera_caption(name: Column) -> Column:
    short = F.element_at(F.split(name, r"\."), -1)
    fixed = F.when(short == "image_0", "camera_top").when(short == "image_1", "camera_left_wrist").when(short == "image_2", "camera_right_wrist")
    loose = F.when(short.contains("image"), F.replace(short, F.lit("image"), F.lit("camera"))).when(short.contains("cam"), F.replace(short, F.lit("cam"), F.lit("camera"))).otherwise(F.concat(F.lit("camera_"), short))
    words = F.lower(F.replace(F.coalesce(fixed, loose), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words)))


def task_hash(text: Column) -> Column:
    """First 8 bytes of the md5 of the stripped lower-case text, as a little-endian signed long."""
    digest = F.md5(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")))
    swapped = F.concat(*[F.substring(digest, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(swapped, 16, -10).cast("long")


def digits(text: Column) -> Column:
    """All digits of the text as one int, null without any."""
    found = F.regexp_replace(text, "[^0-9]", "")
    return F.when(found != "", found.cast("int"))


def media_tokens(t: Column, h: Column, w: Column, merge: int = 2) -> Column:
    return F.floor(t * h * w / (merge * merge)).cast("long")


def prompt(cameras: Column | list[str], bins: Column, instruction: Column) -> Column:
    """Camera lines, the binned state, the instruction and the request; cameras given as a list make a constant."""
    line = lambda c: F.concat(camera_caption(c), F.lit(": "), F.lit(VISION))
    made = F.transform(cameras, line) if isinstance(cameras, Column) else F.array(*[line(F.lit(c)) for c in cameras]).cast("array<string>")
    lines = F.array_join(made, "\n")
    return F.concat(lines, F.lit("\nState: "), F.array_join(F.transform(bins, lambda b: b.cast("string")), " "), F.lit("\nInstruction: "), instruction, F.lit("\nPredict the next actions."))


def span(tokens: Column, marker: int, goal: int) -> Column:
    """struct(start, end): from the first marker to just after the first goal token behind it, else to the marker; null without a marker."""
    start = F.array_position(tokens, marker)
    after = F.array_position(F.slice(tokens, F.greatest(start, F.lit(1)).cast("int"), F.size(tokens)), goal)
    end = F.when(after > 0, start + after - 1).otherwise(start)
    return F.when(start > 0, F.struct((start - 1).alias("start"), end.alias("end")))


def find(tokens: Column, pattern: list[int]) -> Column:
    """0-based place of the first occurrence of pattern, -1 without any; a place is looked at no further than its first other token.

    tokens should be a column that is there, not an expression, as it is read at every place."""
    if not pattern:
        return F.when(tokens.isNotNull(), 0).otherwise(-1)
    at = lambda x, i: reduce(lambda a, b: a & b, [x == pattern[0], *[F.get(tokens, i + k) == p for k, p in enumerate(pattern[1:], 1)]])
    return F.coalesce(F.array_position(F.transform(tokens, at), True) - 1, F.lit(-1)).cast("int")


def discount(steps_to_go: Column, gamma: float = 0.99) -> Column:
    return F.pow(F.lit(gamma), steps_to_go)
