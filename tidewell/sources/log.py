"""The append log: segments of JSON lines with one sequence over all streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from ..operators.numbering import numbered
from ..schema import LOG_ENTRY

SEGMENT_BYTES = 32 << 20
TTL_NS = 2 * 3_600_000_000_000
CAP_BYTES = 2 << 30


class CursorExpired(ValueError):
    """The rows after the cursor are partly gone."""


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_ENTRY).json(path)


def read_from(log: DataFrame, cursor: int, stream: str) -> DataFrame:
    """Entries of a stream after the cursor, in order."""
    if cursor > 0:
        oldest = log.agg(F.min("seq")).first()[0]
        if oldest is not None and cursor < oldest - 1:
            raise CursorExpired(f"cursor {cursor} is older than the log, which starts at {oldest}")
    return log.where((F.col("seq") > cursor) & (F.col("stream") == stream)).orderBy("seq")


def dump(log: DataFrame, container: str, since_ns: int, until_ns: int) -> DataFrame:
    """Intents of a container, or of none, by the time they were appended (both ends included)."""
    return log.where("stream = 'intent'").where(F.col("container_id").isin("", container) & F.col("ts_ns").between(since_ns, until_ns))


def append(batch: DataFrame, path: str, after: int, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a batch with following numbers in arrival order; streams share the sequence.

    No task holds all rows (numbered() says how).  Segments are files of about
    `segment_bytes`, by the mean size of the batch's rows.
    """
    spark, since = batch.sparkSession, scratch.written(batch.sparkSession)
    columns = [c.split()[0] for c in LOG_ENTRY.split(", ")]
    out = numbered(batch.select(*(c for c in columns if c != "seq"), "arrival"), ["arrival"], "seq", after + 1).select(*columns)
    mean = out.agg(F.avg(F.length(F.to_json(F.struct(*columns))) + 1)).first()[0]
    if mean:
        out.write.mode("append").option("maxRecordsPerFile", max(1, int(segment_bytes / mean))).json(path)
    scratch.drop(spark, since)


def collectable(segments: DataFrame, now_ns: int, ttl_ns: int = TTL_NS, cap_bytes: int = CAP_BYTES) -> DataFrame:
    """Segments to delete with the reason: too old, or the oldest of what exceeds the cap; never the open one.

    `segments`: segment, end_ns, bytes, open.
    """
    live = segments.withColumn("old", (~F.col("open")) & (F.lit(now_ns) - F.col("end_ns") > ttl_ns))
    w = Window.orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, 0)  # a row a segment file
    kept = live.where("NOT old").withColumn("upto", F.sum("bytes").over(w))
    trimmed = kept.where((F.col("upto") > cap_bytes) & ~F.col("open")).select("segment", F.lit("size").alias("reason"))
    return live.where("old").select("segment", F.lit("ttl").alias("reason")).unionByName(trimmed)


def segments_of(log: DataFrame, rows: int) -> DataFrame:
    """A log cut into segments of that many entries: segment, end_ns, bytes, open."""
    cut = log.select(F.floor((F.col("seq") - 1) / rows).cast("long").alias("segment"), "ts_ns", F.length(F.to_json(F.struct("*"))).alias("size"))
    found = cut.groupBy("segment").agg(F.max("ts_ns").alias("end_ns"), F.sum("size").alias("bytes"))
    return found.join(F.broadcast(found.agg(F.max("segment").alias("last"))), F.lit(True)).select("segment", "end_ns", "bytes", (F.col("segment") == F.col("last")).alias("open"))  # one row
