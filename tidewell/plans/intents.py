"""Queries: sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intents
from ..sources.events import syscalls
from .registry import query

IDLE = 48 * intents.HOUR_NS

_EPOCHS = "x AS (SELECT *, sum(CASE WHEN op = 'exit' THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY seq ROWS UNBOUNDED PRECEDING) - CASE WHEN op = 'exit' THEN 1 ELSE 0 END AS epoch FROM s)"


def _sessions(ops: str, opener: str) -> str:
    return f"""{_EPOCHS},
x2 AS (SELECT *, max(CASE WHEN op = 'exit' THEN ts_ns END) OVER (PARTITION BY pid, epoch) AS exit_ns FROM x),
m AS (SELECT *, CASE WHEN op = '{opener}' OR lag(op) OVER w IS NULL OR lag(op) OVER w = 'close' OR ts_ns - lag(ts_ns) OVER w >= {IDLE} THEN 1 ELSE 0 END AS fresh
      FROM x2 WHERE op IN ({ops}) WINDOW w AS (PARTITION BY pid, epoch, fd ORDER BY seq)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY pid, epoch, fd ORDER BY seq ROWS UNBOUNDED PRECEDING) AS sid FROM m)"""


_FILES = _sessions("'open', 'read', 'write', 'close'", "open") + f""",
a AS (SELECT pid, epoch, fd, sid, max(path) AS path, max(hint) AS hint, max(exit_ns) AS exit_ns, sum(CASE WHEN op = 'read' THEN bytes ELSE 0 END) AS br,
        sum(CASE WHEN op = 'write' THEN bytes ELSE 0 END) AS bw, min(ts_ns) AS start_ns, max(ts_ns) AS last_ns, count(*) AS n_events,
        max(CASE WHEN op = 'close' THEN 1 ELSE 0 END) AS closed, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS ids
      FROM g GROUP BY pid, epoch, fd, sid),
f AS (SELECT pid, CAST(epoch AS BIGINT) AS epoch, fd, CAST(sid AS BIGINT) AS sid, coalesce(path, '') AS path,
        CASE WHEN br > 0 AND bw = 0 THEN 'FileRead' WHEN br = 0 AND bw > 0 THEN 'FileWrite' WHEN br > 0 THEN 'FileReadWrite'
             WHEN hint = 'openr' THEN 'FileRead' WHEN hint = 'openw' THEN 'FileWrite' WHEN hint = 'openrw' THEN 'FileReadWrite' ELSE 'FileAccess' END AS kind,
        CASE WHEN closed = 1 THEN 1.0 ELSE 0.7 END AS confidence, CAST(br AS BIGINT) AS bytes_read, CAST(bw AS BIGINT) AS bytes_written, start_ns,
        CASE WHEN closed = 0 AND sid = max(sid) OVER (PARTITION BY pid, epoch, fd) AND exit_ns - last_ns < {IDLE} THEN exit_ns ELSE last_ns END AS end_ns, n_events, ids
      FROM a WHERE NOT (closed = 1 AND n_events = 1 AND path IS NULL)) """


@query(_FILES + "SELECT *, CASE WHEN kind IN ('FileWrite', 'FileReadWrite') THEN 2 ELSE 1 END AS severity FROM f")
def a1_file_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents.file_sessions(syscalls(spark, sf_dir), IDLE).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(_FILES + "SELECT kind, confidence, count(*) AS n, CAST(sum(bytes_read) AS BIGINT) AS bytes_read, CAST(sum(bytes_written) AS BIGINT) AS bytes_written FROM f GROUP BY kind, confidence")
def intents_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: events to file intents, counted by kind and confidence."""
    found = intents.file_sessions(syscalls(spark, sf_dir), IDLE)
    return found.groupBy("kind", "confidence").agg(F.count("*").alias("n"), F.sum("bytes_read").alias("bytes_read"), F.sum("bytes_written").alias("bytes_written"))


@query(
    _sessions("'connect', 'read', 'write', 'close'", "connect")
    + """ SELECT pid, CAST(epoch AS BIGINT) AS epoch, fd, CAST(sid AS BIGINT) AS sid, max(CASE WHEN op = 'connect' THEN peer END) AS peer, 'tcp' AS proto,
        CAST(sum(CASE WHEN op = 'write' THEN bytes ELSE 0 END) AS BIGINT) AS bytes_sent, CAST(sum(CASE WHEN op = 'read' THEN bytes ELSE 0 END) AS BIGINT) AS bytes_received,
        min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, 2 AS severity, CASE WHEN max(CASE WHEN op = 'close' THEN 1 ELSE 0 END) = 1 THEN 1.0 ELSE 0.7 END AS confidence
      FROM g GROUP BY pid, epoch, fd, sid HAVING max(CASE WHEN op = 'connect' THEN peer END) IS NOT NULL"""
)
def a2_socket_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents.socket_sessions(syscalls(spark, sf_dir), IDLE)


@query("p AS (SELECT * FROM s WHERE op = 'execute') SELECT seq, pid, 'ProcessStart' AS kind, binary_ AS binary, ts_ns AS start_ns, ts_ns AS end_ns, 2 AS severity, 1.0 AS confidence FROM p")
def a3_process_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents.process_starts(syscalls(spark, sf_dir))
