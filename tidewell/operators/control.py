"""Control loops: downgrade levels, sampling, coalescing and counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Usage from which a level holds, and below which it falls; rates and enrichment by level.
UP = ((0.95, 3), (0.80, 2), (0.60, 1))
DOWN = 0.40
DROP_ALL = 0xFFFFFFFF
RATES = {0: 1, 1: 2, 2: 10, 3: DROP_ALL}
ENRICHMENT = {0: "full", 1: "full", 2: "minimal", 3: "none"}
STRICTNESS = ("full", "minimal", "none")
COALESCE_NS = 100_000_000


def levels(usage: DataFrame, key: str = "pid") -> DataFrame:
    """`usage` (key, seq, usage) with the level after each row: a sorted fold over the rows of a partition, which holds whole keys and one level."""
    schema = f"{key} long, seq long, usage double, level int"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, level = None, 0
        for pdf in batches:
            out = []
            for k, u in zip(pdf[key], pdf["usage"].clip(0.0, 1.0)):
                if k != last:
                    last, level = k, 0
                level = next((max(level, n) for least, n in UP if u >= least), max(level - 1, 0) if u < DOWN else level)
                out.append(level)
            yield pdf.assign(usage=pdf["usage"].clip(0.0, 1.0), level=pd.Series(out, dtype="int32", index=pdf.index))

    return usage.select(F.col(key).cast("long").alias(key), F.col("seq").cast("long").alias("seq"), F.col("usage").cast("double").alias("usage")).repartition(key).sortWithinPartitions(key, "seq").mapInPandas(fold, schema)


def transitions(leveled: DataFrame, key: str = "pid") -> DataFrame:
    """Rows at which the level differs from the one before (0 at first)."""
    before = F.coalesce(F.lag("level").over(Window.partitionBy(key).orderBy("seq")), F.lit(0))
    return leveled.withColumn("before", before).where("level <> before")


def sampling_rate(level: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RATES.items() for x in (kv[0], kv[1]))), level).cast("long")


def enrichment(level: Column, operator: str = "full") -> Column:
    """The stricter of what the level and what the operator ask for."""
    rank = F.greatest(F.lit(STRICTNESS.index(operator)), F.element_at(F.create_map(*(F.lit(x) for k, v in ENRICHMENT.items() for x in (k, STRICTNESS.index(v)))), level))
    return F.element_at(F.array(*map(F.lit, STRICTNESS)), rank + 1)


def keep_sampled(key: Column, rate: int) -> Column:
    """One in `rate`, by hash of the key; 0 and 1 keep all, the drop-all rate nothing."""
    return F.lit(rate != DROP_ALL) if rate in (0, 1, DROP_ALL) else F.pmod(key, F.lit(rate)) == 0


def coalesce_events(events: DataFrame, key: list[str], window_ns: int = COALESCE_NS) -> DataFrame:
    """The first event of each anchored window of a key; it carries count and bytes of the window before, if that held several.

    A window opens at its first event and closes at the first event later than
    `window_ns` after: a fold over each key's sorted rows, of constant state.
    `events` has seq, ts_ns and bytes besides the key columns.
    """
    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in key)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, n, size = None, 0, 0, 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = row[: len(key)]
                seq, ts, b = row[len(key) :]
                if k != last:
                    last, start, n, size = k, ts, 1, b
                    out.append((*k, seq, ts, 0, 0))
                elif ts - start <= window_ns:
                    n, size = n + 1, size + b
                else:
                    out.append((*k, seq, ts, n if n > 1 else 0, size if n > 1 else 0))
                    start, n, size = ts, 1, b
            yield pd.DataFrame(out, columns=[*key, "seq", "ts_ns", "prev_count", "prev_bytes"])

    return events.select(*key, "seq", "ts_ns", "bytes").repartition(*key).sortWithinPartitions(*key, "ts_ns", "seq").mapInPandas(fold, f"{kinds}, seq long, ts_ns long, prev_count long, prev_bytes long")


def debounce(events: DataFrame, key: list[str], gap_ns: int = 250_000_000) -> DataFrame:
    """When a debounced notice runs: at once if `gap_ns` have passed since the last run, else once at the end of the gap."""
    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in key)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ran, due = None, None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k, ts = row[:-1], row[-1]
                if k != last:
                    if due is not None:
                        out.append((*last, due, True))
                    last, ran, due = k, None, None
                if due is not None and ts >= due:
                    out.append((*k, due, True))
                    ran, due = due, None
                if ran is None or ts - ran >= gap_ns:
                    out.append((*k, ts, False))
                    ran = ts
                elif due is None:
                    due = ran + gap_ns
            yield pd.DataFrame(out, columns=[*key, "run_ns", "deferred"])
        if due is not None:
            yield pd.DataFrame([(*last, due, True)], columns=[*key, "run_ns", "deferred"])

    return events.select(*key, "ts_ns").repartition(*key).sortWithinPartitions(*key, "ts_ns").mapInPandas(fold, f"{kinds}, run_ns long, deferred boolean")


def overflow(counters: DataFrame, node: str) -> DataFrame:
    """A summary for each interval in which frames were dropped, from cumulative counters (tick_ns, dropped, frames) in tick order."""
    w = Window.orderBy("tick_ns")  # a row a tick
    d = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    rows = counters.select("tick_ns", d("dropped").alias("dropped"), d("frames").alias("frames"), ((F.col("tick_ns") - F.lag("tick_ns").over(w)) / 1_000_000).cast("long").alias("window_ms"))
    return rows.where("dropped > 0").select("tick_ns", "dropped", "frames", F.format_string("%.6f", F.col("dropped") / (F.col("dropped") + F.col("frames"))).alias("loss_ratio"), "window_ms", F.lit(node).alias("node"))


# The rows of the totals view, in its order.
TOTALS = ["syscalls", "intents", "frames_read", "frames_dropped"]


def totals(counters: DataFrame, n: int = 0) -> DataFrame:
    """(key, total): the four totals of a one-row frame that has them as columns, or the first `n` of them."""
    shown = TOTALS[:n] if 0 < n < len(TOTALS) else TOTALS
    return counters.unpivot([], shown, "key", "total")


def ring_drops(drops: DataFrame, key: str = "cpu", rings: int = 8) -> DataFrame:
    """(ring, dropped): what each of the rings has dropped, from rows (key, n)."""
    return drops.groupBy(F.pmod(key, F.lit(rings)).alias("ring")).agg(F.sum("n").alias("dropped"))


def state_sizes(rows: DataFrame, **columns: str) -> DataFrame:
    """One row: how many different values each named column has."""
    return rows.agg(*(F.countDistinct(c).alias(name) for name, c in columns.items()))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
