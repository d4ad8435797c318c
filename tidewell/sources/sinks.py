"""Where rows go: JSON lines, sharded files, several sinks at once, keyed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import fnv1a32


#: A shard's file is full at this size.
FILE_BYTES = 128 << 20


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def sharded(rows: DataFrame, key: str, shards: int = 4) -> DataFrame:
    return rows.withColumn("shard", F.pmod(fnv1a32(F.col(key)), F.lit(shards)).cast("int"))


def write_sharded(rows: DataFrame, path: str, key: str = "intent_id", shards: int = 4, file_bytes: int = FILE_BYTES) -> None:
    """Newline-delimited JSON in a folder a shard, in files of about `file_bytes` by the mean size of the rows.

    A shard is dealt to as many tasks as its size asks for (adaptive rebalancing), not to one.
    """
    size = rows.select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.avg("n")).first()[0]
    rows_a_file = max(1, int(file_bytes / (size + 1))) if size else 1
    sharded(rows, key, shards).hint("rebalance", "shard").write.mode("append").option("maxRecordsPerFile", rows_a_file).partitionBy("shard").json(path)


def newest_files(files: DataFrame, keep: int = 4) -> DataFrame:
    """What retention keeps of `files` (shard, file, modified_ns)."""
    return files.withColumn("nth", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("modified_ns"), F.desc("file")))).where(F.col("nth") <= keep).drop("nth")


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that computes a batch once for several sinks."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, epoch)
        finally:
            batch.unpersist()

    return run


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return old.unionByName(new).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def without_history(events: DataFrame) -> DataFrame:
    """What goes over the wire: all but the history."""
    return events.drop("history")
