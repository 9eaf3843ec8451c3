"""Trajectory datasets on disk: frame files by episode, metadata files, features and their roles."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.sources.catalog import Catalog
from episodica.sources.shared import exists

FRAMES = "data/*/*.parquet"
EPISODE = "data/chunk-{chunk:03d}/episode_{episode:06d}.parquet"
INFO, EPISODES, TASKS = "meta/info.json", "meta/episodes.jsonl", "meta/tasks.jsonl"
INFO_SCHEMA = "fps double, features map<string, struct<dtype: string, shape: array<int>, names: array<string>>>"
EPISODE_SCHEMA = "episode_index bigint, tasks array<string>, action_config string"
TASK_SCHEMA = "task_index bigint, task string"


def read_frames(spark: SparkSession, root: str, pattern: str = FRAMES) -> DataFrame:
    """All frame files of a dataset as one table."""
    return spark.read.option("basePath", root).parquet(f"{root}/{pattern}")


def read_episodes(spark: SparkSession, root: str, episodes: Iterable[int], pattern: str = EPISODE, chunk_size: int = 1000) -> DataFrame:
    """The frame files of the listed episodes, no others."""
    paths = [f"{root}/{pattern.format(chunk=e // chunk_size, episode=e)}" for e in episodes]
    return spark.read.option("basePath", root).parquet(*paths)


def read_dataset(spark: SparkSession, found: Catalog, name: str) -> DataFrame:
    """The frames of a catalogue's trajectory dataset: its listed episodes (else all), with the columns that tell frames apart and the
    chosen states and actions (else those found by prefix).  Unlisted episodes' files and other columns aren't read."""
    dataset = next((x for x in found.lerobot_datasets if x.repo_id == name), None)
    if dataset is None:
        raise KeyError(f"no trajectory dataset {name}")
    root = dataset.root or dataset.repo_id
    frames = read_episodes(spark, root, dataset.episodes) if dataset.episodes else read_frames(spark, root)
    chosen = [c for c in ("episode_index", "frame_index", "timestamp", "task_index") if c in frames.columns]
    chosen += columns_of(frames, "observation.state", dataset.select_state_keys) + columns_of(frames, "action", dataset.select_action_keys)
    return frames.select(*[f"`{c}`" for c in chosen])


def read_metadata(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """info (one row: fps, features), episodes and tasks.  action_config stays JSON, as it comes in two shapes."""
    return {
        "info": spark.read.schema(INFO_SCHEMA).json(f"{root}/{INFO}", multiLine=True),
        "episodes": spark.read.schema(EPISODE_SCHEMA).json(f"{root}/{EPISODES}"),
        "tasks": spark.read.schema(TASK_SCHEMA).json(f"{root}/{TASKS}"),
    }


def features(info: DataFrame) -> DataFrame:
    """feature, dtype, shape and names: a row for each feature."""
    return info.select(F.explode("features").alias("feature", "_f")).select("feature", "_f.*")


def role(feature: Column, dtype: Column) -> Column:
    """VISUAL for images and videos, ENV for the environment's state, STATE for other observations, ACTION for actions, else null."""
    return F.when(dtype.isin("image", "video"), "VISUAL").when(feature == "observation.environment_state", "ENV").when(feature.startswith("observation"), "STATE").when(feature.startswith("action"), "ACTION")


def with_roles(found: DataFrame) -> DataFrame:
    """Features that have a role, with it; visual ones must have three dimensions, and their shape is given channels first."""
    kind = role(F.col("feature"), F.col("dtype"))
    wrong = F.raise_error(F.concat(F.col("feature"), F.lit(" doesn't have three dimensions"))).cast("array<int>")
    last = F.lower(F.get("names", F.lit(2))).isin("channel", "channels")
    shape = F.when(kind != "VISUAL", F.col("shape")).when(F.size("shape") != 3, wrong).when(last, F.array(F.col("shape")[2], F.col("shape")[0], F.col("shape")[1])).otherwise(F.col("shape"))
    return found.withColumns({"role": kind, "shape": shape}).where("role is not null")


def action_dims(found: DataFrame) -> DataFrame:
    """One row: the sum of the first dimensions of all actions."""
    return found.where("role = 'ACTION'").agg(F.coalesce(F.sum(F.col("shape")[0]), F.lit(0)).cast("long").alias("action_dims"))


def columns_of(df: DataFrame, prefix: str, chosen: list[str] | None = None) -> list[str]:
    """The chosen columns, else those whose names begin with prefix."""
    return list(chosen) if chosen else [c for c in df.columns if c.startswith(prefix)]


def ordered(df: DataFrame, video: list[str], state: list[str], action: list[str]) -> DataFrame:
    """video, state, action, task, all *_is_pad, cam_names and steps_to_go, in this order; a missing column raises."""
    pads = [c for c in df.columns if c.endswith("_is_pad")]
    names = [*video, *state, *action, "task", *pads, "cam_names", "steps_to_go"]
    if missing := [c for c in names if c not in df.columns]:
        raise KeyError(f"no column {', '.join(missing)}")
    return df.select(*[f"`{c}`" for c in names])


def load_all(datasets: Iterable, load: Callable[..., DataFrame]) -> tuple[list[DataFrame], list[tuple[object, str]]]:
    """load of each dataset, and those that failed with their error: a dataset that can't be read doesn't stop the others."""
    found, skipped = [], []
    for dataset in datasets:
        try:
            found.append(load(dataset))
        except Exception as e:  # noqa: BLE001  whatever a reader raises; the caller gets the list
            skipped.append((dataset, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    return found, skipped


def copy_beside(spark: SparkSession, source: str, target: str) -> bool:
    """Copies a small text (a catalogue) to target, as a record of what a table was made from; whether the source was there."""
    from episodica.sources.shared import read_text, write_text

    if not exists(spark, source):
        return False
    write_text(spark, read_text(spark, source), target)
    return True
