"""The session graph: construction, upkeep and its four queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch


def build_edges(events: DataFrame) -> DataFrame:
    """Edges in arrival order: container to process for an exec, process to file, process to peer."""
    proc = "concat('proc:', pid)"
    parts = [
        events.where("op = 'execute' AND container_id <> ''").selectExpr("seq", "concat('e', seq) AS edge_id", "'EXEC' AS kind", "concat('cont:', container_id) AS src", f"{proc} AS dst", "ts_ns", "container_id AS session_id"),
        events.where("op = 'open'").selectExpr("seq", "concat('e', seq) AS edge_id", "'FILE_TOUCH' AS kind", f"{proc} AS src", "concat('file:', path) AS dst", "ts_ns", "container_id AS session_id"),
        events.where("op = 'connect'").selectExpr("seq", "concat('e', seq) AS edge_id", "'IPC_CONNECT' AS kind", f"{proc} AS src", "concat('peer:', peer) AS dst", "ts_ns", "container_id AS session_id"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def accept_edges(edges: DataFrame) -> DataFrame:
    """Edges with an id, both ends and a kind; of equal ids the first."""
    full = edges.where("edge_id <> '' AND src <> '' AND dst <> '' AND kind <> ''")
    return full.withColumn("nth", F.row_number().over(Window.partitionBy("edge_id").orderBy("seq"))).where("nth = 1").drop("nth")


def node_kind(node):
    return F.when(node.startswith("proc:"), "process").when(node.startswith("cont:"), "container").when(node.startswith("file:"), "file").when(node.startswith("peer:"), "peer").otherwise("")


def nodes_of(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "seq").groupBy("id").agg(F.min("seq").alias("seq"))
    return ends.select("id", node_kind(F.col("id")).alias("kind"), "seq")


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """The latest row of each node; an empty kind or label keeps the one before, attributes are replaced."""
    w = Window.partitionBy("id").orderBy("seq")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = nodes.select("id", F.last(F.expr("nullif(kind, '')"), True).over(all_).alias("kind"), F.last(F.expr("nullif(label, '')"), True).over(all_).alias("label"), F.last("attrs").over(all_).alias("attrs"), F.row_number().over(w).alias("nth"))
    return rows.where("nth = 1").select("id", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("label", F.lit("")).alias("label"), "attrs")


def parents(edges: DataFrame) -> DataFrame:
    """(child, parent): the source of the first FORK or EXEC edge into each node."""
    first = Window.partitionBy("dst").orderBy("seq")
    return edges.where("kind IN ('FORK', 'EXEC')").withColumn("nth", F.row_number().over(first)).where("nth = 1").select(F.col("dst").alias("child"), F.col("src").alias("parent"))


def lineage(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, depth, node): the ancestors of each start, nearest first, however many; a cycle ends the walk.

    Pointer doubling: a round knows each start's ancestors up to depth d and each
    node's ancestor at d, and goes on to 2 d.  On a cycle the walk comes to nodes
    it has been at; these are left out, and the rounds end when nothing is new.
    """
    up = scratch.stored(parents(edges), "lineage")
    found = scratch.stored(starts.select("start").distinct().join(up, F.col("start") == F.col("child")).where("start <> parent").select("start", F.lit(1).alias("depth"), F.col("parent").alias("node")), "lineage")
    jump, reach = up, 1
    while True:
        step = jump.select(F.col("child").alias("node"), F.col("parent").alias("next"))
        more = found.join(step, "node").select("start", (F.col("depth") + reach).alias("depth"), F.col("next").alias("node")).where("start <> node")
        more = more.groupBy("start", "node").agg(F.min("depth").alias("depth")).join(found.select("start", "node"), ["start", "node"], "left_anti")
        more = scratch.stored(more.select("start", "depth", "node"), "lineage")
        if more.isEmpty():
            return found
        found = scratch.stored(found.unionByName(more), "lineage")
        jump = scratch.stored(jump.join(jump.select(F.col("child").alias("parent"), F.col("parent").alias("far")), "parent").select("child", F.col("far").alias("parent")), "lineage")
        reach *= 2


def neighbours(edges: DataFrame, kind: str) -> DataFrame:
    """(src, dst, first_seq): distinct targets by edges of one kind, in the order of their first edge."""
    return edges.where(F.col("kind") == kind).groupBy("src", "dst").agg(F.min("seq").alias("first_seq"))


def reaches(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): what each start reaches in at most `depth` steps, itself excluded.

    One join a level against the distinct edges; nodes seen before are left out.
    Each level is stored, so that no plan holds those of the levels before.
    """
    steps = scratch.stored(edges.select("src", "dst").distinct(), "steps")
    seen = scratch.stored(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "reached")
    front = seen
    for level in range(1, depth + 1):
        front = front.join(steps, front.node == steps.src).select("start", F.col("dst").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level))
        front = scratch.stored(front, "reached")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def outgoing(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).orderBy("seq")


def sessions(edges: DataFrame) -> DataFrame:
    return edges.where("session_id <> ''").groupBy("session_id").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.max("seq").alias("last_seq"), F.count("*").alias("edges"))


def purge(edges: DataFrame, closed: DataFrame, now_ns: int, ttl_ns: int) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes that stay when sessions closed `ttl_ns` ago or longer go, with nodes that have no edge left."""
    gone = closed.where(F.lit(now_ns) - F.col("closed_ns") >= ttl_ns).select("session_id")
    kept = edges.join(gone, "session_id", "left_anti")
    return kept, nodes_of(kept)


def capped_sessions(edges: DataFrame, cap: int) -> DataFrame:
    """The `cap` sessions that were updated last: a top-k, not a global window."""
    return sessions(edges).orderBy(F.desc("last_seq")).limit(cap)


def query(edges: DataFrame, node: str, kind: str, max_depth: int = 0) -> DataFrame:
    """The nodes, in order, that one of the four queries gives."""
    spark: SparkSession = edges.sparkSession
    start = spark.createDataFrame([(node,)], "start string")
    if kind == "lineage":
        return lineage(edges, start).orderBy("depth").select("node")
    if kind in ("peers", "touches"):
        return neighbours(edges, "IPC_CONNECT" if kind == "peers" else "FILE_TOUCH").where(F.col("src") == node).orderBy("first_seq").select(F.col("dst").alias("node"))
    if kind == "reaches":
        return reaches(edges, start, max_depth or 3).orderBy("depth", "node").select("node")
    raise ValueError(f"unknown graph query {kind!r}")
