"""Queries: the session graph, enrichment and temporal joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, graph
from ..operators.asof import asof
from ..sources.events import syscalls, table
from .registry import plain, query

_EDGES = """g AS (SELECT seq, 'e' || seq AS edge_id, 'EXEC' AS kind, 'cont:' || container_id AS src, 'proc:' || pid AS dst, ts_ns, container_id AS session_id FROM s WHERE op = 'execute'
 UNION ALL SELECT seq, 'e' || seq, 'FILE_TOUCH', 'proc:' || pid, 'file:' || path, ts_ns, container_id FROM s WHERE op = 'open'
 UNION ALL SELECT seq, 'e' || seq, 'IPC_CONNECT', 'proc:' || pid, 'peer:' || peer, ts_ns, container_id FROM s WHERE op = 'connect')"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_edges(syscalls(spark, sf_dir))


@query("""WITH RECURSIVE u AS (SELECT DISTINCT user_id AS pid FROM events WHERE user_id >= 1), up(start, depth, node) AS (
  SELECT pid, 0, pid FROM u UNION ALL SELECT start, depth + 1, node // 2 FROM up WHERE node >= 1 AND (depth = 0 OR node IN (SELECT pid FROM u)))
 SELECT 'proc:' || start AS start, depth, 'proc:' || node AS node FROM up WHERE depth > 0""")
def g1_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = syscalls(spark, sf_dir).select("pid").where("pid >= 1").distinct()
    edges = users.selectExpr("pid AS seq", "concat('f', pid) AS edge_id", "'FORK' AS kind", "concat('proc:', pid div 2) AS src", "concat('proc:', pid) AS dst", "0L AS ts_ns", "'' AS session_id")
    return graph.lineage(edges, users.selectExpr("concat('proc:', pid) AS start"))


@query(_EDGES + " SELECT src, dst, min(seq) AS first_seq FROM g WHERE kind = 'IPC_CONNECT' GROUP BY src, dst")
def g2_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf_dir), "IPC_CONNECT")


@query(_EDGES + " SELECT src, dst, min(seq) AS first_seq FROM g WHERE kind = 'FILE_TOUCH' GROUP BY src, dst")
def g3_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf_dir), "FILE_TOUCH")


@query("""WITH d AS (SELECT DISTINCT 'cust:' || o_custkey AS src, 'order:' || o_orderkey AS dst FROM orders UNION SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem),
 a AS (SELECT 'cust:' || c_custkey AS start FROM customer), b AS (SELECT DISTINCT a.start, d.dst AS node FROM a JOIN d ON d.src = a.start), c AS (SELECT DISTINCT b.start, d.dst AS node FROM b JOIN d ON d.src = b.node)
 SELECT start, node, 1 AS depth FROM b UNION ALL SELECT start, node, 2 FROM c""")
def g4_reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to orders to parts, three steps at most."""
    orders = table(spark, sf_dir, "orders").selectExpr("concat('cust:', o_custkey) AS src", "concat('order:', o_orderkey) AS dst")
    parts = table(spark, sf_dir, "lineitem").selectExpr("concat('order:', l_orderkey) AS src", "concat('part:', l_partkey) AS dst")
    starts = table(spark, sf_dir, "customer").selectExpr("concat('cust:', c_custkey) AS start")
    return graph.reaches(orders.unionByName(parts), starts, 3)


@query(_EDGES + " SELECT seq, edge_id, kind, dst FROM g WHERE src = 'proc:7'")
def g5_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.outgoing(_edges(spark, sf_dir), "proc:7").select("seq", "edge_id", "kind", "dst")


@query(_EDGES + """, x AS (SELECT *, row_number() OVER (PARTITION BY 'e' || (seq % 500) ORDER BY seq) AS n FROM g WHERE seq % 11 <> 0) SELECT 'e' || (seq % 500) AS edge_id, seq, kind, src, dst FROM x WHERE n = 1""")
def g6_add_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _edges(spark, sf_dir).withColumn("edge_id", F.expr("concat('e', seq % 500)")).withColumn("src", F.expr("IF(seq % 11 = 0, '', src)"))
    return graph.accept_edges(raw).select("edge_id", "seq", "kind", "src", "dst")


@query(_EDGES + """ SELECT id, CASE WHEN id LIKE 'proc:%' THEN 'process' WHEN id LIKE 'cont:%' THEN 'container' WHEN id LIKE 'file:%' THEN 'file' ELSE 'peer' END AS kind, min(seq) AS seq FROM (SELECT src AS id, seq FROM g UNION ALL SELECT dst, seq FROM g) GROUP BY id""")
def g6_auto_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes_of(_edges(spark, sf_dir))


@query(plain("""SELECT 'n' || pid AS id, coalesce(arg_max(CASE WHEN k % 3 = 0 THEN NULL ELSE 'k' || (k % 4) END, seq) FILTER (WHERE k % 3 <> 0), '') AS kind, coalesce(arg_max('l' || k, seq) FILTER (WHERE k % 2 = 0), '') AS label, arg_max(CAST(k AS VARCHAR), seq) AS attrs FROM s GROUP BY pid"""))
def g7_upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).selectExpr("seq", "concat('n', pid) AS id", "IF(k % 3 = 0, '', concat('k', k % 4)) AS kind", "IF(k % 2 = 0, concat('l', k), '') AS label", "map('k', string(k)) AS attrs")
    return graph.upsert_nodes(rows).select("id", "kind", "label", F.col("attrs")["k"].alias("attrs"))


_CLOSED = "closed AS (SELECT session_id, max(ts_ns) AS closed_ns FROM g WHERE session_id IN ('c1', 'c2', 'c3', 'c4') GROUP BY session_id), cut AS (SELECT max(closed_ns) + 1000000000 - 3600000000000 AS mark FROM closed), gone AS (SELECT session_id FROM closed, cut WHERE closed_ns <= mark)"


def _purged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = _edges(spark, sf_dir)
    closed = edges.where("session_id IN ('c1', 'c2', 'c3', 'c4')").groupBy("session_id").agg(F.max("ts_ns").alias("closed_ns"))
    now = closed.agg(F.max("closed_ns")).first()[0] + 1_000_000_000
    return graph.purge(edges, closed, now, 3_600_000_000_000)


@query(_EDGES + ", " + _CLOSED + " SELECT session_id, count(*) AS edges FROM g WHERE session_id NOT IN (SELECT session_id FROM gone) GROUP BY session_id")
def g8_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _purged(spark, sf_dir)[0].groupBy("session_id").agg(F.count("*").alias("edges"))


@query(_EDGES + ", " + _CLOSED + " SELECT id, min(seq) AS seq FROM (SELECT src AS id, seq, session_id FROM g UNION ALL SELECT dst, seq, session_id FROM g) WHERE session_id NOT IN (SELECT session_id FROM gone) GROUP BY id")
def g8_purged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _purged(spark, sf_dir)[1].select("id", "seq")


@query(_EDGES + " SELECT session_id, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, max(seq) AS last_seq, count(*) AS edges FROM g GROUP BY session_id ORDER BY max(seq) DESC LIMIT 4")
def g9_session_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.capped_sessions(_edges(spark, sf_dir), 4)


@query(_EDGES + " SELECT kind, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM g GROUP BY kind")
def g10_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query(_EDGES + " SELECT dst AS node FROM g WHERE src = 'proc:7' AND kind = 'IPC_CONNECT' GROUP BY dst")
def g11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.query(_edges(spark, sf_dir), "proc:7", "peers")


@query("""l AS (SELECT * FROM s WHERE op = 'connect'), r AS (SELECT * FROM s WHERE op = 'open'),
 j AS (SELECT l.seq, r.seq AS r_seq, r.path, row_number() OVER (PARTITION BY l.seq ORDER BY r.seq DESC) AS n FROM l LEFT JOIN r ON l.pid = r.pid AND r.seq < l.seq) SELECT seq, r_seq, path AS r_path FROM j WHERE n = 1""")
def asof_last_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir)
    found = asof(rows.where("op = 'connect'"), rows.where("op = 'open'").select("seq", "ts_ns", "pid", "path", F.col("seq").alias("own")), ["pid"], ["own", "path"])
    return found.select("seq", F.col("r_own").alias("r_seq"), "r_path")


_TIERS = """ev AS (SELECT seq, CASE WHEN k % 10 = 0 THEN 'own' || pid ELSE '' END AS own, pid AS cg, CAST(k % 5 AS BIGINT) AS pid_ns, CAST(k % 2 AS BIGINT) AS mnt_ns FROM s),
 a AS (SELECT c_custkey AS cg, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS cid, 'pod' || c_nationkey AS pod FROM customer), b AS (SELECT CAST(r_regionkey AS BIGINT) AS pid_ns, CAST(r_regionkey % 2 AS BIGINT) AS mnt_ns, r_name AS cid, 'region' AS pod FROM region WHERE r_regionkey > 0)"""


@query(_TIERS + """ SELECT ev.seq, CASE WHEN own <> '' THEN own WHEN coalesce(a.cid, '') <> '' THEN a.cid ELSE coalesce(b.cid, '') END AS container_id,
  CASE WHEN own <> '' THEN '' WHEN coalesce(a.cid, '') <> '' THEN a.pod ELSE coalesce(b.pod, '') END AS pod FROM ev LEFT JOIN a ON ev.cg = a.cg LEFT JOIN b ON ev.pid_ns = b.pid_ns AND ev.mnt_ns = b.mnt_ns""")
def j1_j2_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = syscalls(spark, sf_dir).selectExpr("seq", "IF(k % 10 = 0, concat('own', pid), '') AS container_id", "pid AS cgroup_id", "bigint(k % 5) AS pid_ns", "bigint(k % 2) AS mnt_ns")
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey AS cgroup_id", "IF(c_custkey % 7 = 0, '', c_name) AS container_id", "concat('pod', c_nationkey) AS pod", "'' AS namespace")
    b = table(spark, sf_dir, "region").selectExpr("bigint(r_regionkey) AS pid_ns", "bigint(r_regionkey % 2) AS mnt_ns", "r_name AS container_id", "'region' AS pod", "'' AS namespace")
    return enrich.two_tier(events, a, b).select("seq", "container_id", "pod")


@query("""SELECT c_name AS container_id, n_name AS pod, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey ELSE '' END, ''), nullif(CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '' END, ''), 'ref') AS image,
  'own' AS app, CASE WHEN n_nationkey IS NULL THEN NULL ELSE 'pod' END AS tier FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END""")
def j3_containers_with_pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "customer").selectExpr("c_name AS container_id", "IF(c_custkey % 7 = 0, -1, c_nationkey) AS pod_id", "IF(c_custkey % 3 = 0, concat('u', c_custkey), '') AS user_image", "IF(c_custkey % 3 = 1, c_mktsegment, '') AS image", "'ref' AS image_ref", "map('app', 'own') AS labels")
    pods = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS pod_id", "n_name AS pod", "'' AS namespace", "map('app', 'pod', 'tier', 'pod') AS labels")
    found = enrich.containers_with_pods(boxes, pods)
    return found.select("container_id", "pod", "image", F.col("labels")["app"].alias("app"), F.try_element_at("labels", F.lit("tier")).alias("tier"))


@query("""b AS (SELECT seq, pid AS owner, container_id AS box, CASE WHEN k % 4 = 0 THEN '0.0.0.0' ELSE ip END AS addr, CAST(80 + k % 3 AS VARCHAR) AS port FROM s WHERE op = 'execute'),
 z AS (SELECT b.*, (SELECT min(x.seq) FROM s x WHERE x.op = 'exit' AND x.pid = b.owner AND x.seq > b.seq) AS end_seq FROM b),
 c AS (SELECT seq, peer, CAST(80 + k % 3 AS VARCHAR) AS port, container_id FROM s WHERE op = 'connect'),
 e1 AS (SELECT c.seq, z.owner, z.box, z.end_seq, row_number() OVER (PARTITION BY c.seq ORDER BY z.seq DESC) AS n FROM c JOIN z ON z.addr <> '0.0.0.0' AND z.addr || ':' || z.port = c.peer AND z.seq < c.seq),
 w1 AS (SELECT c.seq, z.owner, z.box, z.end_seq, row_number() OVER (PARTITION BY c.seq ORDER BY z.seq DESC) AS n FROM c JOIN z ON z.addr = '0.0.0.0' AND z.port = c.port AND z.seq < c.seq),
 h AS (SELECT c.seq, c.container_id, CASE WHEN e1.owner IS NOT NULL AND (e1.end_seq IS NULL OR e1.end_seq > c.seq) THEN e1.owner WHEN w1.owner IS NOT NULL AND (w1.end_seq IS NULL OR w1.end_seq > c.seq) THEN w1.owner END AS owner,
   CASE WHEN e1.owner IS NOT NULL AND (e1.end_seq IS NULL OR e1.end_seq > c.seq) THEN e1.box WHEN w1.owner IS NOT NULL AND (w1.end_seq IS NULL OR w1.end_seq > c.seq) THEN w1.box END AS owner_container
   FROM c LEFT JOIN e1 ON e1.seq = c.seq AND e1.n = 1 LEFT JOIN w1 ON w1.seq = c.seq AND w1.n = 1)
 SELECT seq, owner, owner_container FROM h WHERE owner IS NOT NULL AND owner_container <> container_id""")
def j4_live_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).withColumn("port", F.expr("string(80 + k % 3)"))
    binds = rows.where("op = 'execute'").selectExpr("seq", "ts_ns", "IF(k % 4 = 0, '0.0.0.0', ip) AS addr", "port", "pid", "container_id")
    connects = rows.where("op = 'connect'").select("seq", "ts_ns", "peer", "port", "container_id")
    return enrich.live_peers(connects, binds, rows.where("op = 'exit'").select("seq", "pid")).select("seq", "owner", "owner_container")


@query("""WITH RECURSIVE e AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, user_id AS pid, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'view'),
 o AS (SELECT seq, pid, 3 + k % 5 AS fd, 3 + (k // 5) % 5 AS dirfd, CASE WHEN k % 3 = 0 THEN '/d' || k ELSE 'r' || k END AS path FROM e),
 b AS (SELECT o.seq, o.path, (SELECT max(p.seq) FROM o p WHERE p.pid = o.pid AND p.fd = o.dirfd AND p.seq < o.seq) AS base FROM o),
 f(seq, path, base, full_, n) AS (SELECT seq, path, base, CASE WHEN path LIKE '/%' THEN path ELSE path END, 0 FROM b UNION ALL SELECT f.seq, f.path, b.base, b.path || '/' || f.full_, f.n + 1 FROM f JOIN b ON b.seq = f.base WHERE f.full_ NOT LIKE '/%')
 SELECT b.seq, (SELECT max(full_) FROM f WHERE f.seq = b.seq AND f.full_ LIKE '/%') AS full FROM b""")
def j5_dirfd_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).where("op = 'open'").selectExpr("seq", "ts_ns", "pid", "3 + k % 5 AS fd", "3 + (k div 5) % 5 AS dirfd", "IF(k % 3 = 0, concat('/d', k), concat('r', k)) AS path")
    return enrich.dirfd_paths(rows).select("seq", "full")
