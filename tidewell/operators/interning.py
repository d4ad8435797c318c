"""Strings to ids: a number for each new string, forgotten when it has not been seen for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.hashes import fnv1a64
from .numbering import numbered

TTL_NS = 600_000_000_000


def intern(sights: DataFrame, ttl_ns: int = TTL_NS) -> DataFrame:
    """(seq, text, id, fresh) for `sights` (seq, ts_ns, text, backlogged, and `hash` where it is not to be computed).

    Ids count from 1 in the order of `seq`.  A string idle for `ttl_ns` is
    forgotten and gets a new one.  Where the channel of definitions is
    backlogged a new string has no id (0), though a number is spent on it, and is
    tried again at its next sight.  A string whose hash another one holds has no
    id, nor has the empty one.  `fresh` marks the row that defines an id.
    """
    rows = sights.where("text <> ''")
    if "hash" not in rows.columns:
        texts = rows.select("text").distinct()
        rows = rows.join(texts.withColumn("hash", fnv1a64(F.col("text"), whole=True)), "text")
    by_hash = Window.partitionBy("hash").orderBy("seq")
    idle = F.col("ts_ns") - F.lag("ts_ns").over(by_hash)
    rows = rows.withColumn("new", F.when(idle < ttl_ns, 0).otherwise(1)).withColumn("epoch", F.sum("new").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
    defining = F.min(F.when(~F.col("backlogged"), F.struct("seq", "text"))).over(Window.partitionBy("hash", "epoch"))
    rows = scratch.stored(rows.select("seq", "text", defining.alias("first")), "intern")
    tried = rows.where("first IS NULL OR seq <= first.seq").select("seq")
    ids = numbered(tried, ["seq"], "id").select(F.col("seq").alias("at"), "id")
    known = rows.where("seq >= first.seq AND text = first.text").join(ids, F.col("first.seq") == F.col("at")).select("seq", "text", "id", (F.col("seq") == F.col("at")).alias("fresh"))
    others = rows.where("NOT coalesce(seq >= first.seq AND text = first.text, false)").select("seq", "text", F.lit(0).cast("long").alias("id"), F.lit(False).alias("fresh"))
    return known.unionByName(others).unionByName(sights.where("text = ''").select("seq", "text", F.lit(0).cast("long").alias("id"), F.lit(False).alias("fresh")))
