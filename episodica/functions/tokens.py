"""Column expressions on token rows, chat turns and media placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100
START, END = "<|im_start|>", "<|im_end|>"


def chat_pairs(turns: Column, odd: str = "error") -> Column:
    """array of struct(prompt, answer) from turns (role, content): user turn and the head of the reply, then the reply.

    An empty reply has no end token.  A last turn without a reply raises, or is left out with odd="drop"."""
    framed = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["content"], F.lit(f"{END}\n"))
    at = lambda i: F.element_at(turns, i.cast("int"))
    answer = lambda t: F.when(t["content"] == "", "").otherwise(F.concat(t["content"], F.lit(f"{END}\n")))
    pair = lambda k: F.struct(F.concat(framed(at(2 * k - 1)), F.lit(START), at(2 * k)["role"], F.lit("\n")).alias("prompt"), answer(at(2 * k)).alias("answer"))
    n = F.floor(F.size(turns) / 2)
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n), pair)).otherwise(F.array().cast("array<struct<prompt:string,answer:string>>"))
    if odd == "drop":
        return pairs
    return F.when(F.size(turns) % 2 == 0, pairs).otherwise(F.raise_error(F.lit("a turn has no reply")))


def system_turn(message: str) -> str:
    return f"{START}system\n{message}{END}\n" if message else ""


def labels(prompt: Column, answer: Column) -> Column:
    """Labels of prompt tokens followed by answer tokens: the prompt counts for nothing."""
    return F.concat(F.array_repeat(F.lit(IGNORE).cast("long"), F.size(prompt)), answer)


def expand_placeholders(text: Column, token: str, counts: Column) -> Column:
    """The k-th token of text as often as the k-th count says; tokens beyond the counts stay."""
    parts = F.split(text, "\\Q" + token + "\\E", -1)
    times = lambda i: F.coalesce(F.get(counts, i).cast("int"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.repeat(F.lit(token), times(i)))).otherwise(p)), "")


def merged_times(frames: Column, fps: Column, merge: int = 2) -> Column:
    """Seconds of each group of merge frames: the mean of its first and last; the last frame fills up the last group.  Null fps counts as 24."""
    full = F.concat(frames, F.array_repeat(F.element_at(frames, -1), F.pmod(-F.size(frames), F.lit(merge)).cast("int")))
    second = lambda i: F.element_at(full, i.cast("int")) / F.coalesce(fps, F.lit(24.0))
    groups = F.sequence(F.lit(0).cast("long"), (F.size(full) / merge).cast("long") - 1)
    return F.transform(groups, lambda g: (second(g * merge + 1) + second(g * merge + merge)) / 2)


def tenths(seconds: Column) -> Column:
    """A number with one decimal as text, rounded by the exact value of its binary fraction, ties to even; null for NaN and infinities.

    20 x is held exactly as a sum of two doubles (s, and what was rounded away), so that ties are told from near ties, which
    format_string and decimals, which go by the shortest digits, take for each other.  Below 2^52 / 20 in size."""
    sixteen, four = seconds * 16, seconds * 4
    s = sixteen + four
    back = s - sixteen
    lost = (sixteen - (s - back)) + (four - back)
    whole = (F.floor(s) - F.when((s == F.floor(s)) & (lost < 0), 1).otherwise(0)).cast("long")  # floor(20 x)
    exact = (s == F.floor(s)) & (lost == 0)
    half = F.floor(whole / F.lit(2)).cast("long")
    up = (F.pmod(whole, F.lit(2)) == 1) & (~exact | (F.pmod(half, F.lit(2)) == 1))
    n = F.abs(half + up.cast("long"))
    sign = F.when(seconds < 0, F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, F.floor(n / F.lit(10)).cast("long").cast("string"), F.lit("."), (n % 10).cast("string"))
    return F.when(~F.isnan(seconds) & (F.abs(seconds) < F.lit(float(2**52) / 20)), text)


def video_text(times: Column, size: Column, token: str = "<|video_pad|>") -> Column:
    """A video's frames as text: its time and a vision block of size tokens for each."""
    block = F.concat(F.lit("<|vision_start|>"), F.repeat(F.lit(token), size.cast("int")), F.lit("<|vision_end|>"))
    return F.array_join(F.transform(times, lambda t: F.concat(F.lit("<"), tenths(t.cast("double")), F.lit(" seconds>"), block)), "")


def action_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda j: F.concat(F.lit("<|action_token_"), j.cast("string"), F.lit("|>"))), "")


def join_ids(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def split_ids(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.split(text, ",").cast("array<bigint>"))


def media_count(ids: Column, start: int, token: int) -> Column:
    """How often a start token is followed by the media token."""
    return F.size(F.filter(ids, lambda x, i: (x == token) & (i > 0) & (F.get(ids, i - 1) == start)))


def spans(ids: Column, marker: Column, goal: int, action_start: int, action_end: int) -> Column:
    """struct of instruction_start, instruction_end, goal_pos, action_start, action_end_pos, all 0-based; null if any is missing.

    marker: 0-based place of the instruction's marker, -1 without one; the goal token must stand after it."""
    first = lambda token: F.array_position(ids, token) - 1  # noqa: E731  -1 without any
    whole = (marker >= 0) & (first(goal) > marker) & (first(action_start) >= 0) & (first(action_end) >= 0)
    found = F.struct(marker.cast("long").alias("instruction_start"), (first(goal) + 1).alias("instruction_end"), first(goal).alias("goal_pos"), first(action_start).alias("action_start"), first(action_end).alias("action_end_pos"))
    return F.when(whole, found)


def shifted(span: Column, by: Column) -> Column:
    """A span struct with all its places moved on."""
    names = ("instruction_start", "instruction_end", "goal_pos", "action_start", "action_end_pos")
    return F.when(span.isNotNull(), F.struct(*[(span[n] + by).alias(n) for n in names]))


def extended(ids: Column, label: Column, position: Column, span: Column, goal_tokens: Column) -> Column:
    """struct(ids, labels, positions): the action span copied to the end with its positions, then the goal tokens with positions from 0;
    what is appended has no labels.  Rows without a span stay as they are."""
    n = (span["action_end_pos"] - span["action_start"] + 1).cast("int")
    cut = lambda x: F.slice(x, (span["action_start"] + 1).cast("int"), n)
    more = F.array_repeat(F.lit(IGNORE).cast("long"), n + F.size(goal_tokens))
    restart = F.transform(goal_tokens, lambda x, i: i.cast("long"))
    long = F.struct(F.concat(ids, cut(ids), goal_tokens).alias("ids"), F.concat(label, more).alias("labels"), F.concat(position, cut(position), restart).alias("positions"))
    return F.when(span.isNotNull(), long).otherwise(F.struct(ids.alias("ids"), label.alias("labels"), position.alias("positions")))


def next_labels(label: Column) -> Column:
    """The label that each token but the last is to predict."""
    return F.slice(label, F.lit(2), F.greatest(F.size(label) - 1, F.lit(0)))
