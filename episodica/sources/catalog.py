"""Catalogues of datasets in YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.sources.shared import read_text


@dataclass
class InstructionDataset:
    name: str
    json_path: str
    sampling_strategy: str = "all"
    vision_base_path: str | None = None


@dataclass
class TrajectoryDataset:
    repo_id: str
    root: str | None = None
    episodes: list[int] | None = None
    state_mode: str = "MEAN_STD"
    state_relative_action: bool = False
    embodiment_tag: str | None = None
    train_subtask: bool | str = False
    select_video_keys: list[str] | None = None
    select_action_keys: list[str] | None = None
    select_state_keys: list[str] | None = None
    load_quantile_stats: bool = True


@dataclass
class Catalog:
    mm_datasets: list[InstructionDataset] = field(default_factory=list)
    lerobot_datasets: list[TrajectoryDataset] = field(default_factory=list)


# Dims that are relative to the state (True) or absolute, by embodiment.
MASKS = {
    "libero_panda": [True] * 6 + [False],
    "flexiv": [True] * 7 + [False],
    "realman_dual_arm": [True] * 14 + [False] * 2,
    "arx_dual_arm": [True] * 6 + [False] + [True] * 6 + [False],
    "galaxea_r1_pro": [True] * 7 + [False] + [True] * 7 + [False],
    "agibot_g2": [True] * 14 + [False] * 7,
    "full_state_relative": [True] * 32,
    "full_absolute": [False] * 32,
}


def _make(kind, values: dict):
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    return kind(**values)


def read_catalog(path: str, trajectory_only: bool = False, instruction_only: bool = False, spark: SparkSession | None = None) -> Catalog:
    """The catalogue of a YAML file; any other path is one trajectory dataset.  Missing lists are empty, unknown keys raise.

    Either list may be left out; if both flags are set, trajectories win.  spark: reads the file from any store that it reads."""
    if not path.endswith((".yaml", ".yml")):
        return Catalog([], [TrajectoryDataset(repo_id=path)])
    import yaml

    if spark is not None:
        found = yaml.safe_load(read_text(spark, path)) or {}
    else:
        with open(path) as f:
            found = yaml.safe_load(f) or {}
    _make(Catalog, found)
    out = Catalog([_make(InstructionDataset, x) for x in found.get("mm_datasets") or []], [_make(TrajectoryDataset, x) for x in found.get("lerobot_datasets") or []])
    if trajectory_only:
        out.mm_datasets = []
    elif instruction_only:
        out.lerobot_datasets = []
    return out


def mask(tag: str, dims: int) -> list[bool]:
    """The embodiment's mask, cut or filled up with absolute dims; unknown tags raise."""
    return (MASKS[tag] + [False] * dims)[:dims]


def masks(spark: SparkSession) -> DataFrame:
    """tag and mask of every embodiment."""
    return spark.createDataFrame(list(MASKS.items()), "tag string, mask array<boolean>")


def with_mask(df: DataFrame, tags: DataFrame, dims: int, tag: str = "tag") -> DataFrame:
    """Adds mask: that of the row's tag, cut or filled up to dims; unknown tags raise."""
    out = df.join(F.broadcast(tags.select(F.col("tag").alias(tag), F.col("mask").alias("_m"))), tag, "left")  # a row for each embodiment
    missing = F.raise_error(F.concat(F.lit("no embodiment "), F.col(tag))).cast("array<boolean>")
    filled = F.slice(F.concat(F.coalesce("_m", missing), F.array_repeat(F.lit(False), dims)), 1, dims)
    return out.withColumn("mask", filled).drop("_m")
