"""Queries: filters, selectors and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.globs import is_glob, matches_any
from ..operators import control, subscribe
from ..operators.correlate import sensitive
from ..sources.events import syscalls, table
from .registry import plain, query

_STREAMS = """v AS (SELECT seq, CASE WHEN k % 3 = 0 THEN 'intent' WHEN k % 3 = 1 THEN 'deviation' ELSE 'raw' END AS stream, op AS kind, name, t AS category, namespace, container_id AS pod, severity, (k % 100) / 100.0 AS score FROM s)"""


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syscalls(spark, sf_dir).selectExpr("seq", "CASE k % 3 WHEN 0 THEN 'intent' WHEN 1 THEN 'deviation' ELSE 'raw' END AS stream", "op AS kind", "name", "t AS category", "namespace", "container_id AS pod", "severity", "(k % 100) / 100D AS score")


@query(_STREAMS + """ SELECT seq, stream, kind FROM v WHERE (CASE WHEN stream = 'raw' THEN name IN ('open', 'view', 'click_0') OR category IN ('open', 'view', 'click_0') ELSE kind IN ('open', 'view', 'click_0') END)
  AND namespace IN ('ns0', 'ns1') AND (stream = 'deviation' OR severity >= 2)""")
def f1_envelope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscribe.envelope(_streams(spark, sf_dir), subscribe.Filter(kinds=["open", "view", "click_0"], namespaces=["ns0", "ns1"], min_severity=2)).select("seq", "stream", "kind")


@query(_STREAMS + " SELECT seq, kind, score FROM v WHERE stream = 'deviation' AND kind IN ('open', 'close', 'read') AND score >= 0.5 AND namespace IN ('ns2')")
def f2_deviation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscribe.deviations(_streams(spark, sf_dir).where("stream = 'deviation'"), subscribe.Filter(kinds=["open", "close", "read"], min_score=0.5, namespaces=["ns2"])).select("seq", "kind", "score")


@query(_STREAMS + " SELECT seq, name FROM v WHERE stream = 'raw' AND name IN ('view_0', 'click_1') AND category IN ('view', 'click') AND pod IN ('c1', 'c2')")
def f3_raw_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscribe.raw(_streams(spark, sf_dir).where("stream = 'raw'"), ["view_0", "click_1"], ["view", "click"], subscribe.Filter(pods=["c1", "c2"])).select("seq", "name")


@query(plain("SELECT seq, op FROM s WHERE container_id = 'c3' AND op IN ('open', 'connect', 'execute')"))
def f4_session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).where("op IN ('open', 'connect', 'execute')").withColumnRenamed("container_id", "session_id")
    return subscribe.session(rows, "c3").select("seq", "op")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE 'ns' || (c_nationkey % 12) NOT LIKE 'ns2%' AND ('ns' || (c_nationkey % 12) LIKE 'ns1%' OR 'ns' || (c_nationkey % 12) = 'ns5') AND c_mktsegment = 'BUILDING'")
def f5_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("namespace", F.expr("concat('ns', c_nationkey % 12)")).withColumn("labels", F.expr("map('segment', c_mktsegment)"))
    return subscribe.selected(rows, ["ns1*", "ns5"], ["ns2*"], {"segment": "BUILDING"}).select("c_custkey", "c_nationkey")


@query(plain("SELECT seq, path FROM s WHERE regexp_matches(path, '^/data/f1[^/]$') OR regexp_matches(path, '^/[^/]*/f[23]$')"))
def f6_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syscalls(spark, sf_dir).where(matches_any(F.col("path"), ["/data/f1?", "/*/f[23]", "/data/[", "/*"])).select("seq", "path")


@query(plain("""SELECT op, count(*) AS n FROM (SELECT *, k - 5 AS retval FROM s) WHERE CASE WHEN op = 'execute' THEN retval = 0 WHEN op = 'open' THEN retval > 0 WHEN op IN ('read', 'write') THEN retval > 0 WHEN op = 'close' THEN fd <> 0 ELSE true END GROUP BY op"""))
def f7_success_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).selectExpr("*", "k - 5 AS retval")
    gate = "CASE WHEN op = 'execute' THEN retval = 0 WHEN op IN ('open', 'read', 'write') THEN retval > 0 WHEN op = 'close' THEN fd <> 0 ELSE true END"
    return rows.where(gate).groupBy("op").agg(F.count("*").alias("n"))


@query(plain("SELECT k * 15 AS syscall_id, count(*) AS n FROM s WHERE k * 15 BETWEEN 0 AND 999 GROUP BY k"))
def f8_real_syscalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syscalls(spark, sf_dir).selectExpr("k * 15 AS syscall_id").where("syscall_id BETWEEN 0 AND 999").groupBy("syscall_id").agg(F.count("*").alias("n"))


@query(plain("SELECT seq, '/proc' || path AS path FROM s WHERE path IS NOT NULL AND k % 2 = 0"))
def f9_sensitive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).where("path IS NOT NULL").selectExpr("seq", "concat(IF(k % 2 = 0, '/proc', '/var'), path) AS path")
    return rows.where(sensitive(F.col("path")))


@query(plain("SELECT seq, k FROM s WHERE k % 4 = 0 OR (k % 4 = 1 AND (CAST(k AS BIGINT) * 67108864) & 2114060416 <> 0)"))
def f10_namespace_birth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).selectExpr("seq", "k", "CASE k % 4 WHEN 0 THEN 'unreadable' WHEN 1 THEN string(bigint(k) * 67108864L) ELSE '256' END AS flags")
    return rows.where(scalars.makes_namespace(F.col("flags"))).select("seq", "k")


@query(plain("SELECT seq, k FROM s WHERE seq % 10 = 0"))
def f11_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syscalls(spark, sf_dir).where(control.keep_sampled(F.col("seq"), 10)).select("seq", "k")


@query(plain("""SELECT level, count(*) AS n, min(CASE level WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 10 ELSE 4294967295 END) AS rate, min(CASE level WHEN 3 THEN 'none' ELSE 'minimal' END) AS enrichment FROM (SELECT k % 4 AS level FROM s) GROUP BY level"""))
def f12_w13_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling rate and enrichment of each level, where the operator asks for minimal."""
    rows = syscalls(spark, sf_dir).selectExpr("k % 4 AS level").groupBy("level").agg(F.count("*").alias("n"))
    return rows.select("level", "n", control.sampling_rate(F.col("level")).alias("rate"), control.enrichment(F.col("level"), "minimal").alias("enrichment"))


@query(plain("SELECT seq, k FROM s WHERE k % 3 = 1 AND pid % 2 = 0"))
def s14_namespace_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).selectExpr("seq", "k", "bigint(k % 3) AS pid_ns", "bigint(pid % 2) AS mnt_ns")
    return subscribe.namespaces(rows, [(1, 0)], [(2, 1)]).select("seq", "k")


@query(plain("SELECT seq, CASE WHEN k - 50 = 0 THEN 'SUCCESS' ELSE CAST(k - 50 AS VARCHAR) END AS code, (k * 7 & 3) IN (1, 2) OR (k * 7 & 576) <> 0 AS writes FROM s"))
def x1_x2_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syscalls(spark, sf_dir).select("seq", scalars.ret_code(F.col("k") - 50).alias("code"), scalars.opens_for_write(F.col("k") * 7).alias("writes"))


@query(plain("""SELECT seq, CASE k % 3 WHEN 1 THEN coalesce(path, '') WHEN 2 THEN (a & 255) || '.' || ((a >> 8) & 255) || '.' || ((a >> 16) & 255) || '.' || ((a >> 24) & 255) || ':' || (8000 + k) ELSE '' END AS addr
 FROM (SELECT *, (seq * 7919) % 4294967296 AS a FROM s)"""))
def x3_sock_addr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syscalls(spark, sf_dir).select("seq", scalars.sock_addr(F.col("k") % 3, (F.col("seq") * 7919) % 4294967296, F.col("k") + 8000, F.col("path")).alias("addr"))


@query("SELECT r_regionkey AS n, ['CAP_CHOWN', 'CAP_DAC_OVERRIDE', 'CAP_DAC_READ_SEARCH', 'CAP_FOWNER', 'CAP_FSETID'][r_regionkey + 1] AS cap, 'CAP_' || (r_regionkey + 41) AS beyond, CASE r_regionkey WHEN 4 THEN 'PR_SET_DUMPABLE' ELSE '' END AS option FROM region")
def x4_x5_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("r_regionkey").cast("int")
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n"), scalars.cap_name(n).alias("cap"), scalars.cap_name(n + 41).alias("beyond"), scalars.prctl_name(n).alias("option"))


@query(plain("""SELECT k, concat_ws('|', CASE WHEN k & 1 <> 0 THEN 'CLONE_NEWNS' END, CASE WHEN k & 4 <> 0 THEN 'CLONE_NEWIPC' END, CASE WHEN k & 2 <> 0 THEN 'CLONE_NEWNET' END, CASE WHEN k & 8 <> 0 THEN 'CLONE_NEWTIME' END) AS flags, count(*) AS n FROM s GROUP BY k"""))
def x6_clone_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = "(k & 1) * 131072L + IF(k & 2 <> 0, 1073741824L, 0L) + IF(k & 4 <> 0, 134217728L, 0L) + IF(k & 8 <> 0, 128L, 0L)"
    rows = syscalls(spark, sf_dir).selectExpr("k", f"{bits} AS bits")
    return rows.groupBy("k", scalars.clone_flags(F.col("bits")).alias("flags")).agg(F.count("*").alias("n"))


@query(plain("""SELECT seq, CASE WHEN k % 10 = 0 THEN 'unchanged' ELSE CAST(k AS VARCHAR) END AS id, ip AS host, CAST(80 + k % 3 AS VARCHAR) AS port, k AS number, 0 AS whole FROM s"""))
def x7_x9_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir)
    return rows.select("seq", scalars.id_value(F.when(F.col("k") % 10 == 0, F.lit(scalars.UNCHANGED)).otherwise(F.col("k")).cast("long")).alias("id"), scalars.host_of(F.col("peer")).alias("host"), scalars.port_of(F.col("peer")).alias("port"), scalars.leading_int(F.concat("k", F.lit("fd"))).alias("number"), scalars.whole_int(F.concat("k", F.lit("fd"))).alias("whole"))


@query(plain("""SELECT seq, 'run ' || op || ' ' || k AS line, severity, CASE severity WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity_name, severity AS back FROM s"""))
def x10_x16_argv_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir)
    name = scalars.severity_name(F.col("severity"))
    return rows.select("seq", scalars.argv(F.array(F.lit("run"), F.col("op"), F.col("k").cast("string"))).alias("line"), "severity", name.alias("severity_name"), scalars.severity_level(name).alias("back"))


@query(plain("SELECT seq, CASE WHEN k % 2 = 0 THEN '/data/f' || (k % 20) ELSE '/f' || (k % 20) END AS clean FROM s WHERE path IS NOT NULL"))
def x11_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).where("path IS NOT NULL")
    raw = F.when(F.col("k") % 2 == 0, F.concat(F.lit("/./data//x/.."), F.substring("path", 6, 100))).otherwise(F.concat(F.lit("/../data/.."), F.substring("path", 6, 100)))
    return rows.select("seq", scalars.clean_path(raw).alias("clean"))


@query(plain("SELECT seq, CASE WHEN k % 2 = 0 THEN md5(CAST(k AS VARCHAR)) ELSE 'x' || k END AS container, 'u_' || k AS pod FROM s"))
def x12_cgroup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("0::/kubepods.slice/kubepods-pod"), F.concat(F.lit("u_"), "k"), F.lit(".slice/"), F.when(F.col("k") % 2 == 0, F.md5(F.col("k").cast("string"))).otherwise(F.concat(F.lit("cri-containerd-x"), "k")), F.lit(".scope"))
    return syscalls(spark, sf_dir).select("seq", scalars.container_of(line).alias("container"), scalars.pod_uid_of(line).alias("pod"))


@query(plain("SELECT seq, sha256(name || chr(1) || container_id) AS id FROM s"))
def x14_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syscalls(spark, sf_dir).select("seq", F.sha2(F.concat("name", F.lit("\x01"), "container_id"), 256).alias("id"))


@query(plain("""SELECT seq, CASE op WHEN 'execute' THEN binary_ WHEN 'open' THEN path WHEN 'connect' THEN peer ELSE op END AS summary FROM s"""))
def x17_t10_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE op WHEN 'execute' THEN 'ProcessStart' WHEN 'open' THEN 'FileAccess' WHEN 'connect' THEN 'NetworkExchange' ELSE op END")
    attributes = F.create_map(F.lit("binary"), F.col("binary_"), F.lit("path"), F.coalesce("path", F.lit("")), F.lit("peer"), F.col("peer"))
    return syscalls(spark, sf_dir).select("seq", scalars.summary(kind, attributes).alias("summary"))


@query(plain("SELECT seq, k % 5 = 0 AS glob, '{\"seq\":' || seq || ',\"op\":\"' || op || '\"}' AS json FROM s"))
def x19_x20_globs_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir)
    return rows.select("seq", is_glob(F.concat(F.lit("/a/"), F.when(F.col("k") % 5 == 0, "*").otherwise("b"))).alias("glob"), F.to_json(F.struct("seq", "op")).alias("json"))
