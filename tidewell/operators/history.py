"""History kept beside events: rings, ancestors, credentials, first moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ring(rows: DataFrame, key: str, depth: int, now_ns: int | None = None, ttl_ns: int | None = None) -> DataFrame:
    """The newest `depth` rows of each key, then those not older than `ttl_ns`; a depth of 0 or less keeps all rows."""
    out = rows
    if depth > 0:
        out = rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts_ns"), F.desc("seq")))).where(F.col("nth") <= depth).drop("nth")
    return out if ttl_ns is None else out.where(F.col("ts_ns") >= now_ns - ttl_ns)


def as_list(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's values in arrival order, comma-joined; a ring bounds them."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(value).cast("string").alias("v")))), lambda x: x["v"]), ",").alias("entries"))


def cred_transitions(events: DataFrame) -> DataFrame:
    """(seq, pid, ts_ns, from, to, cause) of setuid and setgid events with a new id (`new_id` not empty)."""
    kind = F.when(F.col("operation") == "setgid", "gid").otherwise("uid")
    now = F.when(F.col("operation") == "setgid", F.col("gid")).otherwise(F.col("uid"))
    return events.where("operation IN ('setuid', 'setgid') AND coalesce(new_id, '') <> ''").select("seq", "pid", "ts_ns", F.concat(kind, F.lit("="), now.cast("string")).alias("from"), F.concat(kind, F.lit("="), "new_id").alias("to"), F.col("name").alias("cause"))


def first_distinct(rows: DataFrame, key: str, value: str, n: int = 8) -> DataFrame:
    """The first `n` distinct values of each key, with the place they were first seen."""
    seen = rows.groupBy(key, F.col(value).alias("value")).agg(F.min("seq").alias("first_seq"))
    return seen.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("first_seq"))).where(F.col("nth") <= n)


def bootstrap(rows: DataFrame, key: str, window_ns: int) -> DataFrame:
    """Rows within `window_ns` (inclusive) of their key's first row."""
    start = F.min("ts_ns").over(Window.partitionBy(key))
    return rows.withColumn("start_ns", start).where(F.col("ts_ns") - F.col("start_ns") <= window_ns)


def dropped_at_exit(rows: DataFrame) -> DataFrame:
    """Rows that no later exit of their process has dropped."""
    last = Window.partitionBy("pid")
    return rows.withColumn("last_exit", F.max(F.expr("CASE WHEN op = 'exit' THEN seq END")).over(last)).where("op <> 'exit' AND (last_exit IS NULL OR seq > last_exit)").drop("last_exit")


def most_recent_keys(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """The `cap` keys touched last: a top-k."""
    return rows.groupBy(key).agg(F.max("seq").alias("touched")).orderBy(F.desc("touched")).limit(cap)
