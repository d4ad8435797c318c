"""Behaviour baselines: what is learnt of a workload, and deviations from it."""

from __future__ import annotations

import math

import hashlib
from math import ceil, e, log

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import regex_of
from ..functions.hashes import sketch_buckets

U32 = 2**32 - 1
SYSCALL_CAP = 1024


def counts(events: DataFrame, name: str = "name") -> DataFrame:
    return events.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))


def sketch_size(epsilon: float, delta: float) -> tuple[int, int]:
    """(width, depth) for these error bounds."""
    return ceil(e / epsilon), ceil(log(1 / delta))


def sketch(counted: DataFrame, width: int, depth: int) -> DataFrame:
    """Count-min sketch as a table (row, bucket, n): distinct keys are hashed once, cells saturate at 32 bits."""
    cells = counted.select("n", F.posexplode(sketch_buckets(F.col("name"), width, depth)).alias("row", "bucket"))
    return cells.groupBy("row", "bucket").agg(F.least(F.sum("n"), F.lit(U32)).alias("n"))


def sketch_estimate(cells: DataFrame, keys: DataFrame, width: int, depth: int) -> DataFrame:
    """(name, estimate): the least of a key's cells; absent cells are zero."""
    wanted = keys.select("name").distinct().select("name", F.posexplode(sketch_buckets(F.col("name"), width, depth)).alias("row", "bucket"))
    return wanted.join(cells, ["row", "bucket"], "left").groupBy("name").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def merge_sketches(cells: DataFrame) -> DataFrame:
    """Cell by cell, of sketches with equal dimensions and seeds."""
    return cells.groupBy("row", "bucket").agg(F.least(F.sum("n"), F.lit(U32)).alias("n"))


def transitions(events: DataFrame, per_pid: bool = True, name: str = "name") -> DataFrame:
    """(prev, name, n, prob): first-order transitions, within each process or across the whole stream.

    The stream-wide form has no key: rows are ranged by `seq`, a row's
    predecessor is sought in its own range, and each range's first row takes the
    last one of the range before, of which there is one row a range.
    """
    if per_pid:
        rows = events.select(F.lag(name).over(Window.partitionBy("pid").orderBy("seq")).alias("prev"), F.col(name).alias("name"))
    else:
        rows = global_lag(events.select("seq", F.col(name).alias("name")))
    pairs = rows.where("prev IS NOT NULL").groupBy("prev", "name").agg(F.count("*").alias("n"))
    return pairs.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def global_lag(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """(seq, name, prev) over the order of `seq`, without putting all rows in one task."""
    spark = events.sparkSession
    n = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = events.approxQuantile("seq", [k / n for k in range(1, n)], 0.01)  # n - 1 numbers
    # The range is found by halves, so thousands of them cost no more to look up.
    finder = Bucketizer(splits=[-math.inf, *sorted(set(edges)), math.inf], inputCol="at", outputCol="range")
    rows = finder.transform(events.withColumn("at", F.col("seq").cast("double"))).drop("at")
    inside = rows.withColumn("prev", F.lag("name").over(Window.partitionBy("range").orderBy("seq")))
    last = rows.groupBy("range").agg(F.max_by("name", "seq").alias("last_name"), F.min("seq").alias("first_seq"))
    ends = last.select("range", "first_seq", F.lag("last_name").over(Window.orderBy("range")).alias("before"))  # a row a range
    return inside.join(F.broadcast(ends), "range").select("seq", "name", F.when(F.col("seq") == F.col("first_seq"), F.col("before")).otherwise(F.col("prev")).alias("prev"))


def allow_items(events: DataFrame) -> DataFrame:
    """(category, item, first_seq): what a workload may do, as seen."""
    parts = [
        events.where("op = 'execute'").selectExpr("'exec' AS category", "binary_ AS item", "seq"),
        events.where("op = 'open'").selectExpr("'file' AS category", "path AS item", "seq"),
        events.where("op = 'open' AND hint IN ('openw', 'openrw')").selectExpr("'file.write' AS category", "path AS item", "seq"),
        events.where("op = 'connect'").selectExpr("'peer' AS category", "peer AS item", "seq"),
        events.selectExpr("'syscall' AS category", "name AS item", "seq"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where("item <> ''").groupBy("category", "item").agg(F.min("seq").alias("first_seq"))


def capped_items(items: DataFrame, category: str, cap: int = SYSCALL_CAP) -> DataFrame:
    """The first `cap` items of a category in the order they were first seen (a top-k)."""
    return items.where(F.col("category") == category).orderBy("first_seq", "item").limit(cap)


def profile_id(image: str, label: str, compat: bool = False) -> str:
    """A digest of both; `compat` gives the constant that a hash of nothing makes."""
    return hashlib.sha256(b"" if compat else image.encode() + b"\0" + label.encode()).hexdigest()


def promote(events: DataFrame, min_samples: int) -> DataFrame:
    """(samples, promoted, confidence): confidence grows to 1 at ten times the minimum."""
    row = events.agg(F.count("*").alias("samples"))
    rate = F.lit(0.0) if min_samples == 0 else F.least(F.lit(1.0), F.col("samples") / F.lit(10.0 * min_samples))
    return row.select("samples", (F.col("samples") >= min_samples).alias("promoted"), rate.alias("confidence"))


def merged_id(ids: list[str]) -> str:
    return "merged:" + hashlib.sha256(b"".join(i.encode() + b"\0" for i in sorted(ids))).hexdigest()[:32]


def merge_headers(headers: DataFrame) -> DataFrame:
    """One header of several: samples added, confidence weighted by samples, the widest time span.

    `headers`: profile_id, samples, confidence, start_ns, end_ns, floor.  Profiles with different floors do not merge.
    """
    out = headers.agg(
        F.sum("samples").alias("samples"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"),
        F.coalesce(F.try_divide(F.sum(F.col("confidence") * F.col("samples")), F.sum("samples")), F.lit(0.0)).alias("confidence"),
        F.concat(F.lit("merged:"), F.substring(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list("profile_id")), lambda i: F.concat(i, F.lit("\0")))), 256), 1, 32)).alias("profile_id"),
        F.min("floor").alias("floor"), F.max("floor").alias("top_floor"),
    )
    return out.withColumn("floor", F.when(F.col("floor") == F.col("top_floor"), F.col("floor")).otherwise(F.raise_error(F.lit("profiles with different floors")).cast("double"))).drop("top_floor")


def drift(a: DataFrame, b: DataFrame, freq_a: DataFrame, freq_b: DataFrame, tolerance: float) -> DataFrame:
    """(category, item, change): items only in one profile, and syscalls whose frequency moved by more than `tolerance`."""
    keys = ["category", "item"]
    added = b.join(a, keys, "left_anti").select(*keys, F.lit("added").alias("change"))
    removed = a.join(b, keys, "left_anti").select(*keys, F.lit("removed").alias("change"))
    fa, fb = freq_a.select("name", F.col("freq").alias("fa")), freq_b.select("name", F.col("freq").alias("fb"))
    moved = fa.join(fb, "name", "full").select(F.lit("frequency").alias("category"), F.col("name").alias("item"), (F.coalesce("fb", F.lit(0.0)) - F.coalesce("fa", F.lit(0.0))).alias("delta"))
    moved = moved.where(F.abs("delta") > tolerance).select(*keys, F.when(F.col("delta") > 0, "up").otherwise("down").alias("change"))
    return added.unionByName(removed).unionByName(moved)


def frequencies(events: DataFrame, name: str = "name") -> DataFrame:
    """(name, n, freq); the total comes from the counted names, not from the rows."""
    found = counts(events, name)
    total = found.agg(F.sum("n").alias("total"))
    return found.crossJoin(F.broadcast(total)).select("name", "n", (F.col("n") / F.col("total")).alias("freq"))  # one row


def rare(scored: DataFrame, known: DataFrame, floor: float) -> DataFrame:
    """rare_syscall deviations of events whose name is less frequent in the model than `floor`."""
    rows = scored.join(known.select("name", "freq"), "name", "left").withColumn("freq", F.coalesce("freq", F.lit(0.0)))
    return rows.where(F.col("freq") < floor).select("seq", F.lit("rare_syscall").alias("kind"), F.least(F.lit(1.0), 1 - F.col("freq") / floor).alias("score"), F.concat(F.lit("syscall="), F.col("name")).alias("evidence"))


def markov_anomalies(scored: DataFrame, model: DataFrame, floor: float) -> DataFrame:
    """markov_anomaly deviations: the previous call is known and this one follows it with less than `floor`."""
    rows = scored.withColumn("prev", F.lag("name").over(Window.partitionBy("pid").orderBy("seq"))).where("prev IS NOT NULL")
    known = rows.join(model.select("prev").distinct(), "prev", "left_semi")
    found = known.join(model.select("prev", "name", "prob"), ["prev", "name"], "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))
    return found.where(F.col("prob") < floor).select("seq", F.lit("markov_anomaly").alias("kind"), (1 - F.col("prob")).alias("score"), F.concat("prev", F.lit("->"), "name").alias("evidence"))


def first_of(found: DataFrame, keys: list[str]) -> DataFrame:
    """Report once: the first row of each key."""
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where("nth = 1").drop("nth")


def new_items(scored: DataFrame, allowed: DataFrame, item: str, kind: str, label: str, globs: DataFrame | None = None) -> DataFrame:
    """Items outside an allow-set, each once; `globs` (item) are matched against the distinct items left over."""
    rows = scored.where(F.coalesce(F.col(item), F.lit("")) != "").groupBy(F.col(item).alias("item")).agg(F.min("seq").alias("seq"))
    left = rows.join(allowed.select("item").distinct(), "item", "left_anti")
    if globs is not None:
        patterns = globs.select(regex_of(F.col("item")).alias("pattern")).distinct()
        left = left.join(patterns, F.expr("item rlike pattern"), "left_anti")
    return left.select("seq", F.lit(kind).alias("kind"), F.lit(1.0).alias("score"), F.concat(F.lit(label + "="), F.col("item")).alias("evidence"))
