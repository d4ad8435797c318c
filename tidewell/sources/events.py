"""The fixture tables, and the canonical syscall stream projected out of `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_syscalls(events: DataFrame) -> DataFrame:
    """One canonical row an event: order key `seq`, nanoseconds, process, operation and its operands."""
    rows = events.selectExpr(
        "event_id AS seq", "unix_micros(CAST(ts AS timestamp)) * 1000 AS ts_ns", "user_id AS pid", "event_type AS t", "value",
        "CAST(get_json_object(props, '$.k') AS int) AS k",
    )
    return rows.selectExpr(
        "seq", "ts_ns", "pid", "t", "value", "k", "3 + k % 3 AS fd",
        """CASE t WHEN 'signup' THEN 'execute' WHEN 'view' THEN 'open' WHEN 'purchase' THEN 'close'
             WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'read' ELSE 'write' END
             ELSE CASE WHEN k % 10 = 0 THEN 'exit' ELSE 'connect' END END AS op""",
        "CASE WHEN t = 'view' THEN concat('/data/f', k % 20) END AS path",
        "CASE WHEN t = 'view' THEN element_at(array('openr', 'openw', 'openrw', ''), k % 4 + 1) END AS hint",
        "CAST(floor(value) AS bigint) AS bytes", "concat('/bin/b', k % 7) AS binary_", "concat('10.0.0.', k % 16) AS ip",
        "concat('10.0.0.', k % 16, ':', 80 + k % 3) AS peer", "concat(t, '_', k % 5) AS name",
        "concat('c', pid % 10) AS container_id", "concat('ns', pid % 4) AS namespace", "1 + k % 4 AS severity",
    )


def syscalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_syscalls(table(spark, sf_dir, "events"))
