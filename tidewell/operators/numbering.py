"""Following numbers over an order, without putting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

_ROWS = 33  # bits of monotonically_increasing_id() for a partition's rows


def numbered(rows: DataFrame, order: list[str], name: str = "id", first: int = 1) -> DataFrame:
    """`rows` with the column `name`, counting from `first` in the order of `order`.

    The sorted rows are stored once, each with its place in its partition, and
    numbered from there: a second reading of a range shuffle could deal the rows
    out differently.  The partitions' sizes, a row each, give their first numbers.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_place"))
    placed = scratch.stored(ranged, "numbered").withColumn("_part", F.shiftright("_place", _ROWS))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.col("_place").bitwiseAND(F.lit((1 << _ROWS) - 1))
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.lit(first) + F.col("_before") + own).cast("long")).drop("_part", "_place", "_before")
