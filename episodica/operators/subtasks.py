"""Tasks and subtasks of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.operators.rows import uniform

DEFAULT_TASK = "Do the task."


def task_text(df: DataFrame, tasks: DataFrame, index: str, first: str) -> DataFrame:
    """Adds task: the text of the task index, else the episode's first task, else a fixed sentence; empty texts count as missing."""
    tasks = tasks.select(F.col("task_index").alias(index), F.col("task").alias("_t"))
    text = F.coalesce(F.nullif(F.col("_t"), F.lit("")), F.nullif(F.col(first), F.lit("")), F.lit(DEFAULT_TASK))
    return df.join(tasks, index, "left").withColumn("task", text).drop("_t")


def segment_index(frame: Column, ends: Column) -> Column:
    """0-based segment of a frame: segment i covers [end(i-1), end(i)); frames past the end belong to the last."""
    return F.least(F.size(F.filter(ends, lambda e: e <= frame)), F.size(ends) - 1)


def segment_steps(frame: Column, ends: Column) -> Column:
    """Steps to the segment's end, at least 0."""
    return F.greatest(F.lit(0), F.get(ends, segment_index(frame, ends)) - frame)


def cumulate(texts: Column) -> Column:
    return F.array_join(texts, " ")


def mixture(key: Column, subtask: Column, task: Column, weight: float, seed: int = 42) -> Column:
    """The subtask's text with chance weight, else the task's."""
    return F.when(uniform(key, seed) < weight, subtask).otherwise(task)


def boundaries(config: Column) -> Column:
    """array of struct(end_frame, text) from action_config JSON in either shape, empty for anything else.

    A list has end_frame and action_text; an object's steps have step_description, and their end_frame is all digits of
    the value as one number.  Steps without digits are dropped."""
    text = F.trim(config)
    listed = F.from_json(text, "array<struct<end_frame:string,action_text:string>>")
    steps = F.from_json(text, "struct<steps:array<struct<end_frame:string,step_description:string>>>")["steps"]
    number = lambda s: F.regexp_replace(s["end_frame"], "[^0-9]", "")
    made = lambda s, t: F.struct(F.when(number(s) != "", number(s).cast("int")).alias("end_frame"), s[t].alias("text"))
    found = F.when(text.startswith("["), F.transform(listed, lambda s: made(s, "action_text"))).when(text.startswith("{"), F.transform(steps, lambda s: made(s, "step_description")))
    return F.coalesce(F.filter(found, lambda s: s["end_frame"].isNotNull()), F.array().cast("array<struct<end_frame:int,text:string>>"))


def mixture_weight(mode: str | bool | None) -> float | None:
    """The weight of mixture:w; None for other modes, but mix: and the like raise."""
    if not isinstance(mode, str):
        return None
    name, _, weight = mode.rpartition(":")
    if name != "mixture":
        if name.startswith("mix"):
            raise ValueError(f"{mode!r}: a mixture is written mixture:weight")
        return None
    return float(weight)


def mixture_steps(key: Column, subtask: Column, subtask_steps: Column, task: Column, steps: Column, weight: float, seed: int = 42) -> Column:
    """struct(text, steps): of the subtask with chance weight, else of the task; a subtask worded as the task has the task's steps."""
    text = mixture(key, subtask, task, weight, seed)
    return F.struct(text.alias("text"), F.when(text == task, steps).otherwise(subtask_steps).alias("steps"))
