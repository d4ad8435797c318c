"""ENTER and EXIT frames of a call as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair(frames: DataFrame, keys: list[str] = ["host_tid", "syscall_id"]) -> DataFrame:  # noqa: B006
    """`frames` (keys, seq, ts_ns, phase, n_args, retval, payload) merged.

    ENTERs without arguments go; an EXIT right behind an ENTER of its key takes
    the ENTER's time and payload and its own retval; other EXITs and unary frames
    pass as they are; ENTERs that no EXIT follows vanish.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    rows = frames.where("NOT (phase = 'enter' AND n_args = 0)")
    two_phase = rows.where("phase <> 'unary'").select("*", F.lag("phase").over(w).alias("p"), F.lag("ts_ns").over(w).alias("p_ts"), F.lag("payload").over(w).alias("p_payload"))
    matched = F.col("p") == "enter"
    ends = two_phase.where("phase = 'exit'").select(*keys, "seq", F.when(matched, F.col("p_ts")).otherwise(F.col("ts_ns")).alias("ts_ns"), "retval", F.when(matched, F.col("p_payload")).otherwise(F.col("payload")).alias("payload"), F.coalesce(matched, F.lit(False)).alias("paired"))
    return ends.unionByName(rows.where("phase = 'unary'").select(*keys, "seq", "ts_ns", "retval", "payload", F.lit(False).alias("paired")))
