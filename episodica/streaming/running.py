"""Statistics of streams: windowed ones, and running ones that are kept as mergeable histogram states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators import stats
from episodica.sources.shared import exists


def windowed_stats(events: DataFrame, ts: str, key: str, value: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Count, mean, mean of squares, least and largest value by key and time window; late rows beyond the watermark are dropped.

    The same function serves batch and streaming input."""
    span = F.window(ts, window).alias("span")
    out = events.withWatermark(ts, lateness).groupBy(span, key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg(F.col(value) * F.col(value)).alias("mean_sq"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("span.start").alias("start"), key, "n", "mean", "mean_sq", "min", "max")


class RunningStatistics:
    """Histogram states by keys and dim of all rows that streams have brought so far.

    Every micro-batch is aggregated as a table of its own (with partial aggregation, so a hot key is no task's burden) and
    merged with the states before it: means by weight, counts moved to the common range.  The states after batch k are version k
    under path; a batch that is run again after a failure starts from version k - 1 and replaces what it had written, so
    each row counts once.  A version counts once its writing was finished; a gap in the versions raises, as it would lose rows.  A state
    holds at most bins counts."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bins: int = 5000):
        self.spark, self.path, self.keys, self.by, self.bins = spark, path, keys, [*keys, "dim"], bins

    def _version(self, k: int) -> str:
        return f"{self.path}/states/version={k}"

    def _finished(self, k: int) -> bool:
        return exists(self.spark, f"{self._version(k)}/_SUCCESS")

    def fold(self, batch: DataFrame, k: int) -> None:
        """Merges a batch of components (keys, dim, x) into the states, as version k."""
        new = stats.histogram_states(batch, self.keys, self.bins)
        if k:
            if not self._finished(k - 1):
                raise FileNotFoundError(f"no states of batch {k - 1} under {self.path}")
            old = batch.sparkSession.read.schema(new.schema).parquet(self._version(k - 1))
            new = stats.merge_states(old.unionByName(new), self.by, self.bins)
        new.write.mode("overwrite").parquet(self._version(k))

    def run(self, components: DataFrame) -> None:
        """Folds in all that a streaming table of components has to offer now; a later call goes on where this one ended."""
        query = components.writeStream.foreachBatch(self.fold).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()

    def states(self) -> DataFrame:
        """The latest finished states: keys, dim, n, mean, mean_sq, lo, hi and counts; raises before the first batch."""
        k = -1
        while self._finished(k + 1):
            k += 1
        if k < 0:
            raise FileNotFoundError(f"no states under {self.path}")
        return self.spark.read.parquet(self._version(k))

    def statistics(self) -> DataFrame:
        """keys, dim, n, mean, std, q01 and q99 so far; fewer than two rows raise."""
        return stats.state_quantiles(self.states(), self.by, bins=self.bins)
