"""Queries: correlations, baselines and deviations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline, correlate
from ..operators.intents import HOUR_NS
from ..sources.events import syscalls
from .registry import plain, query

DAY = 24 * HOUR_NS


def _asof_sql(left: str, right: str, on: str, carry: str = "b.seq AS r_seq, b.ts_ns AS r_ts") -> str:
    """The last row of `right` that came before, by a window over the join's candidates."""
    return f"l AS (SELECT * FROM s WHERE {left}), r AS (SELECT * FROM s WHERE {right}), j AS (SELECT a.*, {carry}, row_number() OVER (PARTITION BY a.seq ORDER BY b.ts_ns DESC, b.seq DESC) AS n FROM l a JOIN r b ON {on} AND b.seq < a.seq AND b.ts_ns <= a.ts_ns)"


@query(_asof_sql("op = 'execute'", "op = 'open' AND hint = 'openw'", "(CASE WHEN a.k % 20 < 10 THEN 100 + a.k % 20 END) = (CASE WHEN b.k % 20 < 10 THEN 100 + b.k % 20 END)")
       + f""", hit AS (SELECT * FROM j WHERE n = 1 AND ts_ns - r_ts <= {DAY}), rest AS (SELECT * FROM l WHERE seq NOT IN (SELECT seq FROM hit)),
 p AS (SELECT a.*, b.seq AS r_seq, b.ts_ns AS r_ts, row_number() OVER (PARTITION BY a.seq ORDER BY b.ts_ns DESC, b.seq DESC) AS n FROM rest a JOIN r b ON '/data/f' || (a.k % 20) = b.path AND b.seq < a.seq)
 SELECT seq, 'file_written_then_executed' AS kind, pid, ts_ns, r_seq AS ref_seq, ts_ns - r_ts AS age_ns FROM (SELECT * FROM hit UNION ALL SELECT * FROM p WHERE n = 1 AND ts_ns - r_ts <= {DAY})""")
def j7_written_then_executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).selectExpr("seq", "pid", "ts_ns", "op", "hint", "k", "concat('/data/f', k % 20) AS path", "IF(k % 20 < 10, 100 + k % 20, 0) AS inode")
    return correlate.written_then_executed(rows.where("op = 'execute'"), rows.where("op = 'open' AND hint = 'openw'"), DAY)


@query(_asof_sql("op = 'execute'", "op = 'write'", "a.k % 20 = b.k % 20") + f" SELECT seq, 'exec_after_chmod_x' AS kind, pid, ts_ns, r_seq AS ref_seq, ts_ns - r_ts AS age_ns FROM j WHERE n = 1 AND ts_ns - r_ts <= {DAY}")
def j8_exec_after_chmod(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).withColumn("path", F.expr("concat('/data/f', k % 20)"))
    return correlate.exec_after_chmod(rows.where("op = 'execute'"), rows.where("op = 'write'"), DAY)


@query(_asof_sql("op = 'connect'", "op = 'read'", "a.ip = b.ip") + f" SELECT seq, 'connect_after_dns' AS kind, pid, ts_ns, r_seq AS ref_seq, ts_ns - r_ts AS age_ns FROM j WHERE n = 1 AND ts_ns - r_ts <= {DAY}")
def j9_connect_after_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir)
    return correlate.connect_after_dns(rows.where("op = 'connect'"), rows.where("op = 'read'"), DAY)


@query(_asof_sql("op = 'connect'", "op = 'open' AND path LIKE '%/f1%'", "a.pid = b.pid") + f" SELECT seq, 'read_sensitive_before_send' AS kind, pid, ts_ns, r_seq AS ref_seq, ts_ns - r_ts AS age_ns FROM j WHERE n = 1 AND ts_ns - r_ts <= {DAY}")
def j10_read_before_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir)
    return correlate.read_before_send(rows.where("op = 'connect'"), rows.where("op = 'open'"), DAY, parts=("/f1",))


@query(_asof_sql("op IN ('connect', 'execute')", "op = 'open' AND k % 3 = 0", "a.pid = b.pid") + f" SELECT seq, 'privilege_escalation_window' AS kind, pid, ts_ns, CAST(NULL AS BIGINT) AS ref_seq, ts_ns - r_ts AS age_ns FROM j WHERE n = 1 AND ts_ns - r_ts <= {DAY}")
def j11_after_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).withColumn("new_uid", F.expr("k % 3"))
    return correlate.after_escalation(rows.where("op IN ('connect', 'execute')"), rows.where("op = 'open'"), DAY)


@query(plain("SELECT name, count(*) AS n FROM s GROUP BY name"))
def a5_syscall_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.counts(syscalls(spark, sf_dir))


@query("""w AS (SELECT name, lag(name) OVER (PARTITION BY pid ORDER BY seq) AS prev FROM s), c AS (SELECT prev, name, count(*) AS n FROM w WHERE prev IS NOT NULL GROUP BY prev, name)
SELECT prev, name, n, n / sum(n) OVER (PARTITION BY prev) AS prob FROM c""")
def a7_w1_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.transitions(syscalls(spark, sf_dir))


@query("""w AS (SELECT name, lag(name) OVER (ORDER BY seq) AS prev FROM s), c AS (SELECT prev, name, count(*) AS n FROM w WHERE prev IS NOT NULL GROUP BY prev, name)
SELECT prev, name, n, n / sum(n) OVER (PARTITION BY prev) AS prob FROM c""")
def w2_global_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.transitions(syscalls(spark, sf_dir), per_pid=False)


_ITEMS = """i AS (SELECT 'exec' AS category, binary_ AS item, seq FROM s WHERE op = 'execute' UNION ALL SELECT 'file', path, seq FROM s WHERE op = 'open'
 UNION ALL SELECT 'file.write', path, seq FROM s WHERE op = 'open' AND hint IN ('openw', 'openrw') UNION ALL SELECT 'peer', peer, seq FROM s WHERE op = 'connect' UNION ALL SELECT 'syscall', name, seq FROM s)"""


@query(_ITEMS + " SELECT category, item, min(seq) AS first_seq FROM i GROUP BY category, item")
def a8_allow_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.allow_items(syscalls(spark, sf_dir))


@query(_ITEMS + " SELECT category, item, min(seq) AS first_seq FROM i WHERE category = 'syscall' GROUP BY category, item ORDER BY min(seq), item LIMIT 10")
def a8_capped_syscalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.capped_items(baseline.allow_items(syscalls(spark, sf_dir)), "syscall", 10)


@query(plain("SELECT count(*) AS samples, count(*) >= 5000 AS promoted, least(1.0, count(*) / 50000.0) AS confidence FROM s"))
def a9_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.promote(syscalls(spark, sf_dir), 5000)


_HEADERS = "h AS (SELECT 'p' || (pid % 3) AS profile_id, count(*) AS samples, 0.1 * (1 + pid % 3) AS confidence, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM s GROUP BY pid % 3)"


@query(_HEADERS + """ SELECT CAST(sum(samples) AS BIGINT) AS samples, min(start_ns) AS start_ns, max(end_ns) AS end_ns, sum(confidence * samples) / sum(samples) AS confidence, 0.05 AS floor FROM h""")
def a10_merge_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).groupBy(F.expr("pid % 3").alias("p")).agg(F.count("*").alias("samples"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"))
    headers = rows.selectExpr("concat('p', p) AS profile_id", "samples", "0.1D * (1 + p) AS confidence", "start_ns", "end_ns", "0.05D AS floor")
    return baseline.merge_headers(headers).drop("profile_id")


@query(_ITEMS.replace("i AS", "i0 AS") + """, d AS (SELECT DISTINCT i0.category, i0.item, s.pid % 3 AS p FROM i0 JOIN s USING (seq)),
 fa AS (SELECT name, count(*) * 1.0 / (SELECT count(*) FROM s WHERE pid % 3 = 0) AS f FROM s WHERE pid % 3 = 0 GROUP BY name), fb AS (SELECT name, count(*) * 1.0 / (SELECT count(*) FROM s WHERE pid % 3 = 1 AND k < 60) AS f FROM s WHERE pid % 3 = 1 AND k < 60 GROUP BY name),
 b AS (SELECT DISTINCT i0.category, i0.item FROM i0 JOIN s USING (seq) WHERE pid % 3 = 1 AND k < 60), a AS (SELECT category, item FROM d WHERE p = 0)
 SELECT category, item, 'added' AS change FROM b WHERE (category, item) NOT IN (SELECT category, item FROM a) UNION ALL SELECT category, item, 'removed' FROM a WHERE (category, item) NOT IN (SELECT category, item FROM b)
 UNION ALL SELECT 'frequency', coalesce(fa.name, fb.name), CASE WHEN coalesce(fb.f, 0) > coalesce(fa.f, 0) THEN 'up' ELSE 'down' END FROM fa FULL JOIN fb ON fa.name = fb.name WHERE abs(coalesce(fb.f, 0) - coalesce(fa.f, 0)) > 0.004""")
def a11_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir)
    a, b = rows.where("pid % 3 = 0"), rows.where("pid % 3 = 1 AND k < 60")
    return baseline.drift(baseline.allow_items(a), baseline.allow_items(b), baseline.frequencies(a), baseline.frequencies(b), 0.004)


_TRAIN = "tr AS (SELECT * FROM s WHERE seq % 4 <> 0), f AS (SELECT name, count(*) * 1.0 / (SELECT count(*) FROM tr) AS freq FROM tr GROUP BY name)"


@query(_TRAIN + " SELECT s.seq, 'rare_syscall' AS kind, least(1.0, 1 - coalesce(freq, 0) / 0.04) AS score, 'syscall=' || s.name AS evidence FROM s LEFT JOIN f ON s.name = f.name WHERE s.seq % 4 = 0 AND coalesce(freq, 0) < 0.04")
def w3_rare_syscalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir)
    return baseline.rare(rows.where("seq % 4 = 0"), baseline.frequencies(rows.where("seq % 4 <> 0")), 0.04)


@query("""w AS (SELECT name, lag(name) OVER (PARTITION BY pid ORDER BY seq) AS prev FROM s WHERE seq % 4 <> 0), c AS (SELECT prev, name, count(*) AS n FROM w WHERE prev IS NOT NULL GROUP BY prev, name),
 m AS (SELECT prev, name, n / sum(n) OVER (PARTITION BY prev) AS prob FROM c), v AS (SELECT seq, name, lag(name) OVER (PARTITION BY pid ORDER BY seq) AS prev FROM s WHERE seq % 4 = 0)
 SELECT v.seq, 'markov_anomaly' AS kind, 1 - coalesce(prob, 0) AS score, v.prev || '->' || v.name AS evidence FROM v LEFT JOIN m ON m.prev = v.prev AND m.name = v.name WHERE v.prev IN (SELECT prev FROM m) AND coalesce(prob, 0) < 0.04""")
def w4_markov_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir)
    return baseline.markov_anomalies(rows.where("seq % 4 = 0"), baseline.transitions(rows.where("seq % 4 <> 0")), 0.04)


def _new_sql(item: str, where: str, kind: str, label: str, extra: str = "") -> str:
    return f"""v AS (SELECT {item} AS item, seq FROM s WHERE {where}), half AS (SELECT quantile_disc(seq, 0.5) AS mid FROM s),
 learnt AS (SELECT DISTINCT item FROM v, half WHERE seq <= mid) SELECT min(seq) AS seq, '{kind}' AS kind, 1.0 AS score, '{label}=' || item AS evidence FROM v, half WHERE seq > mid AND item NOT IN (SELECT item FROM learnt) {extra} GROUP BY item"""


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    half = rows.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seq)")).first()[0]
    return rows.where(F.col("seq") <= half), rows.where(F.col("seq") > half)


@query(_new_sql("'/bin/b' || k || '.' || pid", "op = 'execute'", "new_exec", "binary"))
def j12_new_exec(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt, scored = _split(syscalls(spark, sf_dir).withColumn("item", F.expr("concat('/bin/b', k, '.', pid)")))
    return baseline.new_items(scored.where("op = 'execute'"), learnt.where("op = 'execute'"), "item", "new_exec", "binary")


@query(_new_sql("'10.0.0.' || k || ':' || pid", "op = 'connect'", "new_connect_target", "peer"))
def j12_new_connect_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt, scored = _split(syscalls(spark, sf_dir).withColumn("item", F.expr("concat('10.0.0.', k, ':', pid)")))
    return baseline.new_items(scored.where("op = 'connect'"), learnt.where("op = 'connect'"), "item", "new_connect_target", "peer")


@query(_new_sql("'/data/g' || k || '.' || pid", "op = 'open'", "new_file_path", "path", "AND NOT regexp_matches(item, '^/data/g1[^/]*$') AND NOT regexp_matches(item, '^/data/g[^/]5[^/]*$')"))
def j12_new_file_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt, scored = _split(syscalls(spark, sf_dir).withColumn("item", F.expr("concat('/data/g', k, '.', pid)")))
    globs = spark.createDataFrame([("/data/g1*",), ("/data/g?5*",)], "item string")
    return baseline.new_items(scored.where("op = 'open'"), learnt.where("op = 'open'"), "item", "new_file_path", "path", globs)


@query("r AS (SELECT *, row_number() OVER (PARTITION BY op, binary_ ORDER BY seq) AS n FROM s WHERE op = 'execute') SELECT seq, binary_ FROM r WHERE n = 1")
def d1_report_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.first_of(syscalls(spark, sf_dir).where("op = 'execute'"), ["op", "binary_"]).select("seq", "binary_")
