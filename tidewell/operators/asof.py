"""Latest earlier row of another table for the same keys, without a range join."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], carry: list[str], order: list[str] = ["ts_ns", "seq"], within_ns: int | None = None, prefix: str = "r_", ranges: int = 1) -> DataFrame:  # noqa: B006
    """`left` with the columns `carry` of the last row of `right` before it, nulls where there is none.

    Both sides are sorted once by (keys, order); a row of `right` only counts if
    it comes earlier in `order`.  Rows older than `within_ns` do not match.

    A key's rows are sorted in one task; where a key holds too many for that, they
    are dealt into `ranges` of time, and each range takes over the last row of
    those before it, of which there is one a key and range.
    """
    ts = order[0]
    packed = F.struct(F.col(ts).alias("at"), *(F.col(c).alias(c) for c in carry))
    a = left.select(*left.columns, F.lit(0).alias("side"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("found"))
    b = right.select(*(F.col(c) if c in keys + order else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.lit(1).alias("side"), packed.alias("found"))
    rows = a.unionByName(b)
    if ranges > 1:
        edges = rows.approxQuantile(ts, [k / ranges for k in range(1, ranges)], 0.01)  # ranges - 1 numbers
        finder = Bucketizer(splits=[-math.inf, *sorted(set(edges)), math.inf], inputCol="_at", outputCol="_range")
        rows = finder.transform(rows.withColumn("_at", F.col(ts).cast("double"))).drop("_at")
    parts = [*keys, "_range"] if ranges > 1 else keys
    window = Window.partitionBy(*parts).orderBy(*order, "side").rowsBetween(Window.unboundedPreceding, 0)
    rows_ = rows.withColumn("last", F.last("found", ignorenulls=True).over(window)).where("side = 0")
    if ranges > 1:
        ends = rows.groupBy(*parts).agg(F.max_by("found", F.when(F.col("side") == 1, F.struct(*order))).alias("end"))
        before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(parts)), F.last("end", ignorenulls=True).over(before).alias("carried"))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(parts)])
        rows_ = rows_.join(carried, same, "left").withColumn("last", F.coalesce("last", "carried"))
    rows = rows_
    fresh = F.lit(True) if within_ns is None else F.col(ts) - F.col("last.at") <= within_ns
    return rows.select(*left.columns, *(F.when(fresh, F.col(f"last.{c}")).alias(prefix + c) for c in ["at", *carry]))
