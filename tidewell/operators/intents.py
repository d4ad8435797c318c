"""Sessions of file, socket and process activity, in batch.

A file session lives on (pid, fd).  It ends at a close (confidence 1.0), at an
open of the same fd, at the process's exit, after `idle_ns` without activity, or
at the end of the input (0.7 each).  Keys are states between windows: one sort by
(pid, seq) serves the exit epochs, and one by (pid, epoch, fd) the sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
CONTRIBUTING = 256


def with_epochs(events: DataFrame) -> DataFrame:
    """Adds `epoch`, how often the process has exited before, and `exit_ns`, the exit that ends it (null: none)."""
    return events.selectExpr(
        "*", "sum(int(op = 'exit')) OVER (PARTITION BY pid ORDER BY seq ROWS UNBOUNDED PRECEDING) - int(op = 'exit') AS epoch"
    ).selectExpr("*", "max(CASE WHEN op = 'exit' THEN ts_ns END) OVER (PARTITION BY pid, epoch) AS exit_ns")


def file_sessions(events: DataFrame, idle_ns: int, cap: int = CONTRIBUTING) -> DataFrame:
    """(pid, epoch, fd, sid, path, kind, severity, confidence, bytes_read, bytes_written, start_ns, end_ns, n_events, ids)."""
    rows = with_epochs(events).where("op IN ('open', 'read', 'write', 'close')").selectExpr(
        "*",
        f"""int(op = 'open' OR coalesce(lag(op) OVER w, 'close') = 'close' OR ts_ns - lag(ts_ns) OVER w >= {idle_ns}) AS fresh""".replace("OVER w", "OVER (PARTITION BY pid, epoch, fd ORDER BY seq)"),
    )
    rows = rows.selectExpr("*", "sum(fresh) OVER (PARTITION BY pid, epoch, fd ORDER BY seq ROWS UNBOUNDED PRECEDING) AS sid")
    # The newest `cap` rows of a session are numbered from its end: only these are gathered, however long it is.
    rows = rows.selectExpr("*", "row_number() OVER (PARTITION BY pid, epoch, fd, sid ORDER BY seq DESC) AS back")
    found = rows.groupBy("pid", "epoch", "fd", "sid").agg(
        F.max("path").alias("path"), F.max("hint").alias("hint"), F.max("exit_ns").alias("exit_ns"),
        F.sum(F.expr("CASE WHEN op = 'read' THEN bytes ELSE 0L END")).alias("bytes_read"),
        F.sum(F.expr("CASE WHEN op = 'write' THEN bytes ELSE 0L END")).alias("bytes_written"),
        F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("last_ns"), F.count("*").alias("n_events"),
        F.max(F.expr("int(op = 'close')")).alias("closed"),
        F.array_sort(F.collect_list(F.when(F.col("back") <= cap, F.col("seq")))).alias("ids"),
    )
    found = found.where("NOT (closed = 1 AND n_events = 1 AND path IS NULL)")
    return found.selectExpr(
        "pid", "epoch", "fd", "sid", "coalesce(path, '') AS path",
        """CASE WHEN bytes_read > 0 AND bytes_written = 0 THEN 'FileRead' WHEN bytes_read = 0 AND bytes_written > 0 THEN 'FileWrite'
             WHEN bytes_read > 0 THEN 'FileReadWrite' WHEN hint = 'openr' THEN 'FileRead' WHEN hint = 'openw' THEN 'FileWrite'
             WHEN hint = 'openrw' THEN 'FileReadWrite' ELSE 'FileAccess' END AS kind""",
        "IF(closed = 1, 1.0D, 0.7D) AS confidence", "bytes_read", "bytes_written", "start_ns",
        f"""CASE WHEN closed = 0 AND sid = max(sid) OVER (PARTITION BY pid, epoch, fd) AND exit_ns - last_ns < {idle_ns} THEN exit_ns ELSE last_ns END AS end_ns""",
        "n_events", "ids",
    ).withColumn("severity", F.expr("IF(kind IN ('FileWrite', 'FileReadWrite'), 2, 1)"))


def socket_sessions(events: DataFrame, idle_ns: int) -> DataFrame:
    """Sessions on (pid, fd) that a connect opens: bytes sent and received until a close, exit, new connect or idleness."""
    rows = with_epochs(events).where("op IN ('connect', 'read', 'write', 'close')").selectExpr(
        "*",
        f"""int(op = 'connect' OR coalesce(lag(op) OVER w, 'close') = 'close' OR ts_ns - lag(ts_ns) OVER w >= {idle_ns}) AS fresh""".replace("OVER w", "OVER (PARTITION BY pid, epoch, fd ORDER BY seq)"),
    )
    rows = rows.selectExpr("*", "sum(fresh) OVER (PARTITION BY pid, epoch, fd ORDER BY seq ROWS UNBOUNDED PRECEDING) AS sid")
    found = rows.groupBy("pid", "epoch", "fd", "sid").agg(
        F.max(F.expr("CASE WHEN op = 'connect' THEN peer END")).alias("peer"),
        F.sum(F.expr("CASE WHEN op = 'write' THEN bytes ELSE 0L END")).alias("bytes_sent"),
        F.sum(F.expr("CASE WHEN op = 'read' THEN bytes ELSE 0L END")).alias("bytes_received"),
        F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), F.max(F.expr("int(op = 'close')")).alias("closed"),
    )
    return found.where("peer IS NOT NULL").selectExpr(
        "pid", "epoch", "fd", "sid", "peer", "'tcp' AS proto", "bytes_sent", "bytes_received", "start_ns", "end_ns", "2 AS severity", "IF(closed = 1, 1.0D, 0.7D) AS confidence"
    )


def process_starts(events: DataFrame) -> DataFrame:
    """A finished intent for each successful execute."""
    return events.where("op = 'execute'").selectExpr("seq", "pid", "'ProcessStart' AS kind", "binary_ AS binary", "ts_ns AS start_ns", "ts_ns AS end_ns", "2 AS severity", "1.0D AS confidence")
