"""Statistics files: nested JSON of feature, statistic and values by dim; on the driver, as they hold a row for each dim."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators import stats as S
from episodica.sources.shared import exists, read_text, write_text

COLUMNS = ("min", "max", "mean", "std", "q01", "q99")
#: What normalisation needs, and what the short form of a file holds.
NORM = ("mean", "std", "q01", "q99")
SCHEMA = "feature string, dim long, " + ", ".join(f"{c} double" for c in COLUMNS)
STATS, RELATIVE, MODEL = "meta/norm_stats.json", "meta/state_relative_ck{horizon}_norm_stats.json", "statistics.json"


def table_of(spark: SparkSession, tree: dict) -> DataFrame:
    """feature, dim and the statistics, null where absent."""
    rows = []
    for feature, found in tree.items():
        found = {c: v for c, v in found.items() if v is not None}
        for dim in range(max(map(len, found.values()), default=0)):
            rows.append((feature, dim, *[float(found[c][dim]) if c in found else None for c in COLUMNS]))
    return spark.createDataFrame(rows, SCHEMA)


def nested(stats: DataFrame, columns: tuple[str, ...] = COLUMNS) -> dict:
    """The nested form of a statistics table: one row for each dim of each feature."""
    out: dict = {}
    for r in sorted(stats.collect(), key=lambda r: (r["feature"], r["dim"])):
        for c in columns:
            if r[c] is not None:
                out.setdefault(r["feature"], {}).setdefault(c, []).append(r[c])
    return out


def read_stats(spark: SparkSession, path: str) -> DataFrame | None:
    """The statistics of a file, None if it isn't there."""
    return table_of(spark, json.loads(read_text(spark, path))) if exists(spark, path) else None


def write_stats(stats: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS, replace: bool = False) -> bool:
    """Writes the file, unless it is there already; whether it was written."""
    spark = stats.sparkSession
    if not replace and exists(spark, path):
        return False
    write_text(spark, json.dumps(nested(stats, columns)), path)
    return True


def with_file(spark: SparkSession, builtin: DataFrame, path: str) -> DataFrame:
    """Statistics of builtin, replaced one by one where the file has a value; a missing file raises."""
    found = read_stats(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return S.override(builtin, found, ["feature", "dim"])


def with_relative_actions(spark: SparkSession, root: str, horizon: int, stats: DataFrame) -> DataFrame:
    """Statistics of actions from the file of state-relative actions over this horizon; what it lacks stays as it was."""
    return with_file(spark, stats, f"{root}/{RELATIVE.format(horizon=horizon)}")


def of_features(stats: DataFrame, features: list[str]) -> DataFrame:
    """The statistics of these features."""
    return stats.where(F.col("feature").isin(*features))


def write_model_stats(spark: SparkSession, path: str, datasets: dict[str, tuple[dict, DataFrame]], state_mode: str) -> None:
    """The file beside a model: features and statistics of each dataset by name, those of the first also at the top."""
    made = {name: {"features": features, "stats": nested(stats)} for name, (features, stats) in datasets.items()}
    first = next(iter(made.values()), {"features": {}, "stats": {}})
    write_text(spark, json.dumps({"state_mode": state_mode, **first, "datasets": made}), path)


def read_model_stats(spark: SparkSession, path: str, dataset: str | None = None, state_mode: str | None = None) -> tuple[DataFrame, dict, str]:
    """Statistics, features and mode of a dataset in the file beside a model; of the first if it has no such name."""
    tree = json.loads(read_text(spark, path))
    found = tree.get("datasets", {}).get(dataset, tree)
    return table_of(spark, found["stats"]), found["features"], state_mode or tree["state_mode"]


def flatten(tree: dict, prefix: str = "", sep: str = "/") -> dict:
    """Nested dicts as one with names joined by sep."""
    out: dict = {}
    for k, v in tree.items():
        out |= flatten(v, f"{prefix}{k}{sep}", sep) if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def unflatten(flat: dict, sep: str = "/") -> dict:
    """The nested form of flat names."""
    out: dict = {}
    for name, v in flat.items():
        *path, last = name.split(sep)
        node = out
        for k in path:
            node = node.setdefault(k, {})
        node[last] = v
    return out


def buffer_name(feature: str) -> str:
    return feature.replace(".", "_")


def feature_name(key: str) -> str:
    return key.replace("/", ".")
