"""Filters of subscriptions, selectors and admin views."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import matches_any


@dataclass(frozen=True)
class Filter:
    kinds: list[str] = field(default_factory=list)
    namespaces: list[str] = field(default_factory=list)
    pods: list[str] = field(default_factory=list)
    min_severity: int = 0
    min_score: float = 0.0


def _within(col: str, wanted: list[str], null_passes: bool) -> Column:
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.col(col).isin(wanted), F.lit(null_passes))


def envelope(rows: DataFrame, f: Filter) -> DataFrame:
    """Rows of `stream` intent, deviation or raw that pass; deviations have no severity, raw kinds are names or categories."""
    raw = F.col("stream") == "raw"
    kind = F.lit(True) if not f.kinds else F.when(raw, F.col("name").isin(f.kinds) | F.col("category").isin(f.kinds)).otherwise(F.col("kind").isin(f.kinds))
    severe = F.lit(True) if f.min_severity <= 0 else (F.col("stream") == "deviation") | (F.col("severity") >= f.min_severity)
    return rows.where(kind & _within("namespace", f.namespaces, True) & _within("pod", f.pods, True) & severe)


def deviations(rows: DataFrame, f: Filter) -> DataFrame:
    """By kind, least score, namespace and pod; rows without metadata fail where those are asked for."""
    kind = F.lit(True) if not f.kinds else F.col("kind").isin(f.kinds)
    score = F.lit(True) if f.min_score <= 0 else F.col("score") >= f.min_score
    return rows.where(kind & score & _within("namespace", f.namespaces, False) & _within("pod", f.pods, False))


def raw(rows: DataFrame, syscalls: list[str], categories: list[str], f: Filter) -> DataFrame:
    name = F.lit(True) if not syscalls else F.col("name").isin(syscalls)
    category = F.lit(True) if not categories else F.col("category").isin(categories)
    return rows.where(name & category & _within("namespace", f.namespaces, False) & _within("pod", f.pods, False))


def session(edges: DataFrame, session_id: str) -> DataFrame:
    return edges.where(F.lit(session_id != "") & (F.col("session_id") == session_id))


def selected(rows: DataFrame, include: list[str], exclude: list[str], labels: dict[str, str]) -> DataFrame:
    """By selector: no excluded namespace glob, any included one (none: all), all labels equal."""
    ns = F.coalesce("namespace", F.lit(""))
    keep = ~matches_any(ns, exclude)
    if include:
        keep = keep & matches_any(ns, include)
    for k, v in labels.items():
        keep = keep & F.coalesce(F.try_element_at("labels", F.lit(k)) == v, F.lit(False))
    return rows.where(keep)


def namespaces(rows: DataFrame, targets: list[tuple[int, int]], excepted: list[tuple[int, int]]) -> DataFrame:
    """By (pid_ns, mnt_ns) pairs: only the targets where there are any, else all but the excepted."""
    among = lambda pairs: F.coalesce(F.struct("pid_ns", "mnt_ns").isin([F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in pairs]), F.lit(False))
    return rows.where(among(targets)) if targets else rows.where(~among(excepted)) if excepted else rows


def resume(log: DataFrame, cursor: int, on_expired: str = "reset_to_live") -> DataFrame:
    """What a subscriber is replayed: the log after its cursor; of an expired cursor nothing, all there is, or an error."""
    oldest = log.agg(F.min("seq")).first()[0]
    if cursor > 0 and oldest is not None and cursor < oldest - 1:
        if on_expired == "fail":
            raise ValueError("cursor expired")
        return log.limit(0) if on_expired == "reset_to_live" else log.orderBy("seq")
    return log.where(F.col("seq") > cursor).orderBy("seq")
