"""Where queries and their SQL are registered, and the tables they share.

Events stand for frames (a user is an episode, an event type a task), embeddings and order lines for vectors, documents
for rows with lengths and sources, conversations for instruction records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators import chunks, stats
from episodica.operators.rows import hot_keys
from episodica.sources.tables import table

HORIZON, CAPACITY = 16, 8192
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FRAMES = "WITH f AS (SELECT user_id AS episode_index, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
LINES = "WITH x AS (SELECT l_returnflag AS dataset, unnest([0, 1, 2, 3]) AS dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem)"
def line_vector():
    return F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")


EMB = "WITH x AS (SELECT vec_id, label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: What orders the events of an episode.
ORDER = ["ts", "event_id"]


def hot_episodes(spark: SparkSession, d: str) -> DataFrame | None:
    """Users with too many events for one task."""
    return hot_keys(table(spark, d, "events").select("user_id"), "user_id")


def events_as_frames(spark: SparkSession, d: str, hot: DataFrame | str | None = chunks.LOOK) -> DataFrame:
    """The events of a user are an episode, ordered by time."""
    events = table(spark, d, "events").select(F.col("user_id").alias("episode_index"), "event_id", "ts", "event_type", "value", "props")
    return chunks.frames(events, "episode_index", ORDER, hot)


def event_chunks(spark: SparkSession, d: str, value, horizon: int) -> DataFrame:
    """Frames with the chunk of values from each on; hot episodes are looked up once."""
    hot = hot_episodes(spark, d)
    return chunks.chunk(events_as_frames(spark, d, hot), value, horizon, frame=ORDER, hot=hot)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return stats.dims(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "dataset"), line_vector(), ["dataset"])


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return stats.dims(table(spark, d, "embeddings"), "embedding", ["vec_id", "label"])


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def rounded(*names: str, places: int = 6) -> list:
    return [F.round(F.col(n), places).alias(n) for n in names]
