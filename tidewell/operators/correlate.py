"""Time-windowed correlations: each trigger with the latest earlier observation it follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof

#: Path parts that are sensitive by default.
SENSITIVE = ("/etc/shadow", "/etc/gshadow", "/proc/", "/etc/ssh/", ".aws/credentials", ".kube/config")


def sensitive(path, parts=SENSITIVE):
    found = F.lit(False)
    for p in parts:
        found = found | path.contains(p)
    return found


def _named(found: DataFrame, kind: str, ref: bool = True) -> DataFrame:
    return found.where("r_at IS NOT NULL").select(F.col("seq"), F.lit(kind).alias("kind"), F.col("pid"), F.col("ts_ns"), (F.col("r_seq") if ref else F.lit(None).cast("long")).alias("ref_seq"), (F.col("ts_ns") - F.col("r_at")).alias("age_ns"))


def written_then_executed(execs: DataFrame, writes: DataFrame, within_ns: int) -> DataFrame:
    """An exec of a file that was written: by inode where both know it, else by path."""
    by_inode = asof(execs.where("inode <> 0"), writes.where("inode <> 0"), ["inode"], ["seq"], within_ns=within_ns)
    hit = by_inode.where("r_at IS NOT NULL")
    rest = execs.join(hit.select("seq"), "seq", "left_anti")
    by_path = asof(rest, writes, ["path"], ["seq"], within_ns=within_ns)
    return _named(hit.select(by_path.columns).unionByName(by_path), "file_written_then_executed")


def exec_after_chmod(execs: DataFrame, chmods: DataFrame, within_ns: int) -> DataFrame:
    return _named(asof(execs, chmods, ["path"], ["seq"], within_ns=within_ns), "exec_after_chmod_x")


def connect_after_dns(connects: DataFrame, answers: DataFrame, within_ns: int) -> DataFrame:
    return _named(asof(connects, answers, ["ip"], ["seq"], within_ns=within_ns), "connect_after_dns")


def read_before_send(sends: DataFrame, reads: DataFrame, within_ns: int, parts=SENSITIVE) -> DataFrame:
    return _named(asof(sends, reads.where(sensitive(F.col("path"), parts)), ["pid"], ["seq"], within_ns=within_ns), "read_sensitive_before_send")


def after_escalation(triggers: DataFrame, setuids: DataFrame, within_ns: int) -> DataFrame:
    return _named(asof(triggers, setuids.where("new_uid = 0"), ["pid"], ["seq"], within_ns=within_ns), "privilege_escalation_window", ref=False)


def enabled(found: dict[str, DataFrame], names: list[str] | None) -> list[str]:
    """Which correlations run: all for None, none for an empty list."""
    unknown = set(names or ()) - set(found)
    if unknown:
        raise ValueError(f"unknown correlations: {sorted(unknown)}")
    return [k for k in found if names is None or k in names]
