"""Streams in and out: tails, interval joins, report-once, cursors and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def tail(spark: SparkSession, path: str, schema: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df, files_a_batch: int = 100) -> DataFrame:
    """A log folder as a stream, filtered before anything else; the query's checkpoint is the cursor."""
    return keep(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path))


def replay_then_tail(spark: SparkSession, path: str, schema: str, cursor: int) -> tuple[DataFrame, DataFrame]:
    """(rows after the cursor so far, the stream): one source, so nothing is missed between the two."""
    old = spark.read.schema(schema).json(path).where(F.col("seq") > cursor)
    return old, tail(spark, path, schema, lambda df: df.where(F.col("seq") > cursor))


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str) -> DataFrame:
    """Pairs of a trigger and an observation of its key at most `within` earlier; both sides have `at` and forget by watermark."""
    a = left.withWatermark("at", within).alias("a")
    b = right.withWatermark("at", within).alias("b")
    return a.join(b, F.expr(f"a.{key} = b.{key} AND b.at <= a.at AND b.at >= a.at - INTERVAL {within}")).selectExpr("a.seq AS seq", f"a.{key} AS {key}", "a.at AS at", "b.seq AS ref_seq", "b.at AS ref_at")


def latest_only(pairs: DataFrame) -> DataFrame:
    """The latest observation of each trigger in a batch of interval_join(): for foreachBatch."""
    return pairs.groupBy("seq").agg(F.max_by("ref_seq", F.struct("ref_at", "ref_seq")).alias("ref_seq"))


def report_once(found: DataFrame) -> DataFrame:
    return found.dropDuplicates(["kind", "evidence"])


def commit_cursor(path: str, consumer: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a consumer's last sequence number, a row a batch."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.agg(F.max("seq").alias("seq")).where("seq IS NOT NULL").select(F.lit(consumer).alias("consumer"), "seq", F.lit(epoch).alias("epoch")).write.mode("append").json(path)

    return run


def cursor_of(spark: SparkSession, path: str, consumer: str) -> int:
    found = spark.read.schema("consumer string, seq long, epoch long").json(path).where(F.col("consumer") == consumer).agg(F.max("seq")).first()[0]
    return found or 0


class Counters(StreamingQueryListener):
    """Totals over all progress reports: input rows by query."""

    def __init__(self):
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event):
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
