"""Queries: contracts, history, control loops, logs, policies and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline, contract, control, history, pairing, policy, subscribe
from ..operators.intents import HOUR_NS
from ..sources import log, sinks, wire
from ..sources.events import syscalls
from .registry import plain, query

DAY = 24 * HOUR_NS

# --- contracts ---------------------------------------------------------------

_OBSERVED = "obs AS (SELECT DISTINCT 'file.read' AS category, '/data/f' || k AS subject FROM s WHERE pid % 2 = 0), pol AS (SELECT DISTINCT 'file.read' AS category, '/data/f' || k AS subject FROM s WHERE k % 3 <> 0), glb AS (SELECT '/data/f1?' AS g, '^/data/f1[^/]$' AS r UNION ALL SELECT '/data/g*', '^/data/g[^/]*$')"


def _rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = syscalls(spark, sf_dir)
    empty = ["'' AS peer", "'' AS fqdn", "'' AS binary", "'' AS name"]
    observed = rows.where("pid % 2 = 0").selectExpr("'file.read' AS category", "concat('/data/f', k) AS path", "'' AS path_glob", *empty).distinct()
    exact = rows.where("k % 3 <> 0").selectExpr("'file.read' AS category", "concat('/data/f', k) AS path", "'' AS path_glob", *empty).distinct()
    globs = spark.createDataFrame([("file.read", "", g, "", "", "", "") for g in ("/data/f1?", "/data/g*")], exact.schema)
    return observed, exact.unionByName(globs)


@query(_OBSERVED + """ SELECT 'observed_but_denied' AS kind, category, subject, 'policy does not allow reading this path' AS reason FROM obs WHERE subject NOT IN (SELECT subject FROM pol) AND NOT EXISTS (SELECT 1 FROM glb WHERE regexp_matches(subject, r))
 UNION ALL SELECT 'unused_allowance', 'file.read', subject, 'policy allows read but no observation matched' FROM pol WHERE subject NOT IN (SELECT subject FROM obs)
 UNION ALL SELECT 'unused_allowance', 'file.read', g, 'policy allows read but no observation matched' FROM glb WHERE NOT EXISTS (SELECT 1 FROM obs WHERE regexp_matches(subject, r))""")
def a12_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.gap(*_rules(spark, sf_dir))


@query(_OBSERVED + """, u AS (SELECT subject FROM pol UNION SELECT g FROM glb) SELECT (SELECT count(*) FROM obs WHERE subject IN (SELECT subject FROM u)) AS inter, (SELECT count(*) FROM (SELECT subject FROM obs UNION SELECT subject FROM u)) AS total,
  1 - (SELECT count(*) FROM obs WHERE subject IN (SELECT subject FROM u)) * 1.0 / (SELECT count(*) FROM (SELECT subject FROM obs UNION SELECT subject FROM u)) AS distance""")
def a13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (r.select(contract.subject().alias("subject")) for r in _rules(spark, sf_dir))
    return contract.jaccard(a, b)


@query(_OBSERVED + """, u AS (SELECT subject FROM pol UNION SELECT g FROM glb), n AS (SELECT (SELECT count(*) FROM obs) AS observed, (SELECT count(*) FROM obs WHERE subject NOT IN (SELECT subject FROM pol) AND NOT EXISTS (SELECT 1 FROM glb WHERE regexp_matches(subject, r))) AS denied)
 SELECT observed, denied, (observed - denied) * 100.0 / observed AS coverage_percent, 1 - (SELECT count(*) FROM obs WHERE subject IN (SELECT subject FROM u)) * 1.0 / (SELECT count(*) FROM (SELECT subject FROM obs UNION SELECT subject FROM u)) AS drift FROM n""")
def a14_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.gap_summary(*_rules(spark, sf_dir))


_DECIDED = """it AS (SELECT seq, CASE k % 8 WHEN 0 THEN 'ProcessStart' WHEN 1 THEN 'FileRead' WHEN 2 THEN 'FileWrite' WHEN 3 THEN 'FileAccess' WHEN 4 THEN 'FileReadWrite' WHEN 5 THEN 'NetworkExchange' WHEN 6 THEN 'DNSAnswer' ELSE 'Other' END AS kind,
  CASE WHEN pid % 9 = 0 THEN '' WHEN k % 8 = 0 THEN binary_ WHEN k % 8 = 5 THEN peer WHEN k % 8 = 6 THEN 'h' || (k % 5) || '.example.org' ELSE '/data/f' || (k % 20) END AS subject FROM s),
 ok AS (SELECT *, subject IN ('/bin/b0', '/bin/b2', '/bin/b4') AS x, (subject LIKE '/data/f1_' OR subject = '/data/f2') AS r, (subject IN ('/data/f3', '/data/f4', '/data/f10')) AS w, subject LIKE '10.0.0.5:%' AND subject IN ('10.0.0.5:80', '10.0.0.5:81') AS e, (subject = 'h1.example.org' OR subject LIKE 'h3.%') AS d FROM it),
 de AS (SELECT seq, kind, subject, CASE WHEN subject = '' THEN true WHEN kind = 'ProcessStart' THEN x WHEN kind = 'FileRead' THEN r WHEN kind = 'FileWrite' THEN w WHEN kind = 'FileAccess' THEN r OR w WHEN kind = 'FileReadWrite' THEN r AND w WHEN kind = 'NetworkExchange' THEN e WHEN kind = 'DNSAnswer' THEN d ELSE true END AS allow,
  CASE kind WHEN 'ProcessStart' THEN CASE WHEN subject = '' THEN 'missing binary attr' WHEN x THEN 'exec permitted' ELSE 'exec not in allow-set: ' || subject END
   WHEN 'FileRead' THEN CASE WHEN subject = '' THEN 'missing path attr' WHEN r THEN 'file.read permitted' ELSE 'file.read not in allow-set: ' || subject END
   WHEN 'FileWrite' THEN CASE WHEN subject = '' THEN 'missing path attr' WHEN w THEN 'file.write permitted' ELSE 'file.write not in allow-set: ' || subject END
   WHEN 'FileAccess' THEN CASE WHEN subject = '' THEN 'missing path attr' WHEN r OR w THEN 'file.access permitted' ELSE 'file.access not in allow-set: ' || subject END
   WHEN 'FileReadWrite' THEN CASE WHEN subject = '' THEN 'missing path attr' WHEN NOT r THEN 'file.read not in allow-set: ' || subject WHEN NOT w THEN 'file.write not in allow-set: ' || subject ELSE 'file.read+write permitted' END
   WHEN 'NetworkExchange' THEN CASE WHEN subject = '' THEN 'missing peer attr' WHEN e THEN 'egress permitted' ELSE 'egress not in allow-set: ' || subject END
   WHEN 'DNSAnswer' THEN CASE WHEN subject = '' THEN 'missing query attr' WHEN d THEN 'dns permitted' ELSE 'dns not in allow-set: ' || subject END ELSE 'out_of_scope' END AS reason FROM ok)"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).selectExpr(
        "seq", "element_at(array('ProcessStart', 'FileRead', 'FileWrite', 'FileAccess', 'FileReadWrite', 'NetworkExchange', 'DNSAnswer', 'Other'), k % 8 + 1) AS kind",
        "CASE WHEN pid % 9 = 0 THEN '' WHEN k % 8 = 0 THEN binary_ WHEN k % 8 = 5 THEN peer WHEN k % 8 = 6 THEN concat('h', k % 5, '.example.org') ELSE concat('/data/f', k % 20) END AS subject",
    )
    none = dict(path="", path_glob="", peer="", fqdn="", binary="", name="")
    made = [("exec", {"binary": f"/bin/b{n}"}) for n in (0, 2, 4)] + [("file.read", {"path_glob": "/data/f1?"}), ("file.read", {"path": "/data/f2"})]
    made += [("file.write", {"path": f"/data/f{n}"}) for n in (3, 4, 10)] + [("network.egress", {"peer": f"10.0.0.5:{n}"}) for n in (80, 81)]
    made += [("network.egress", {"fqdn": "h1.example.org"}), ("network.egress", {"fqdn": "h3.*"})]
    rules = spark.createDataFrame([tuple({"category": c, **none, **v}.values()) for c, v in made], "category string, path string, path_glob string, peer string, fqdn string, binary string, name string")
    return contract.decide(rules, rows)


@query(_DECIDED + " SELECT * FROM de")
def f13_j6_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir)


@query(_DECIDED + " SELECT count(*) AS total, count(*) FILTER (WHERE allow) AS allowed, count(*) FILTER (WHERE NOT allow) AS denied FROM de")
def a15_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.replay(_decisions(spark, sf_dir))


@query(_DECIDED + " SELECT seq, kind, reason FROM de WHERE NOT allow ORDER BY seq LIMIT 20")
def o5_denied_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.denied_samples(_decisions(spark, sf_dir), 20)


@query(plain("""SELECT category, path, '' AS peer, binary_ AS binary, name FROM (
 SELECT DISTINCT CASE WHEN path IN (SELECT path FROM s WHERE hint IN ('openw', 'openrw')) THEN 'file.write' ELSE 'file.read' END AS category, path, '' AS binary_, '' AS name FROM s WHERE op = 'open'
 UNION ALL SELECT DISTINCT 'exec', '', binary_, '' FROM s WHERE op = 'execute' UNION ALL SELECT DISTINCT 'syscalls', '', '', name FROM s) UNION ALL SELECT DISTINCT 'network.egress', '', peer, '', '' FROM s WHERE op = 'connect'"""))
def p1_u4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = baseline.allow_items(syscalls(spark, sf_dir)).where("category <> ''")
    return contract.ordered(contract.rules_of(items, 1.0, 0.5)).select("category", "path", "peer", "binary", "name")


# --- history -----------------------------------------------------------------

@query("""r AS (SELECT pid, seq, op, ts_ns, row_number() OVER (PARTITION BY pid ORDER BY ts_ns DESC, seq DESC) AS n FROM s), t AS (SELECT max(ts_ns) - 5 * 86400000000000 AS lo FROM s)
SELECT pid, string_agg(op, ',' ORDER BY seq) AS entries FROM r, t WHERE n <= 32 AND ts_ns >= lo GROUP BY pid""")
def w5_recent_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir)
    now = rows.agg(F.max("ts_ns")).first()[0]
    return history.as_list(history.ring(rows, "pid", 32, now, 5 * DAY), "pid", "op")


@query("r AS (SELECT pid, seq, binary_, row_number() OVER (PARTITION BY pid ORDER BY ts_ns DESC, seq DESC) AS n FROM s WHERE op = 'execute') SELECT pid, string_agg(binary_, ',' ORDER BY seq) AS entries FROM r WHERE n <= 16 GROUP BY pid")
def w6_w8_exec_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.as_list(history.ring(history.ring(syscalls(spark, sf_dir).where("op = 'execute'"), "pid", 20), "pid", 16), "pid", "binary_")


@query(plain("SELECT seq, pid, ts_ns, CASE WHEN k % 2 = 0 THEN 'gid=' ELSE 'uid=' END || k AS \"from\", CASE WHEN k % 2 = 0 THEN 'gid=' ELSE 'uid=' END || (k + 1) AS \"to\", name AS cause FROM s WHERE k % 3 <> 0"))
def w7_cred_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).selectExpr("*", "IF(k % 2 = 0, 'setgid', 'setuid') AS operation", "k AS uid", "k AS gid", "IF(k % 3 = 0, '', string(k + 1)) AS new_id")
    return history.cred_transitions(rows)


@query("""b AS (SELECT *, min(ts_ns) OVER (PARTITION BY container_id) AS t0 FROM s), c AS (SELECT container_id, binary_ AS value, min(seq) AS first_seq FROM b WHERE ts_ns - t0 <= 172800000000000 AND op = 'execute' GROUP BY container_id, binary_),
 d AS (SELECT *, row_number() OVER (PARTITION BY container_id ORDER BY first_seq) AS nth FROM c) SELECT * FROM d WHERE nth <= 4""")
def w9_d2_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.bootstrap(syscalls(spark, sf_dir), "container_id", 2 * DAY)
    return history.first_distinct(rows.where("op = 'execute'"), "container_id", "binary_", 4)


@query(plain("SELECT seq, op FROM (SELECT *, max(CASE WHEN op = 'exit' THEN seq END) OVER (PARTITION BY pid) AS x FROM s) WHERE op <> 'exit' AND (x IS NULL OR seq > x)"))
def w10_dropped_at_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.dropped_at_exit(syscalls(spark, sf_dir)).select("seq", "op")


@query(plain("SELECT pid, max(seq) AS touched FROM s GROUP BY pid ORDER BY max(seq) DESC LIMIT 20"))
def w11_recent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.most_recent_keys(syscalls(spark, sf_dir), "pid", 20)


# --- control -----------------------------------------------------------------

_LEVELS = """WITH RECURSIVE e AS (SELECT user_id AS pid, event_id AS seq, least(1.0, CAST(json_extract(props, '$.k') AS INT) / 90.0) AS usage, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 f(pid, seq, usage, n, level, before) AS (SELECT pid, seq, usage, n, CASE WHEN usage >= 0.95 THEN 3 WHEN usage >= 0.8 THEN 2 WHEN usage >= 0.6 THEN 1 ELSE 0 END, 0 FROM e WHERE n = 1
  UNION ALL SELECT e.pid, e.seq, e.usage, e.n, CASE WHEN e.usage >= 0.95 THEN 3 WHEN e.usage >= 0.8 THEN greatest(f.level, 2) WHEN e.usage >= 0.6 THEN greatest(f.level, 1) WHEN e.usage < 0.4 THEN greatest(f.level - 1, 0) ELSE f.level END, f.level
   FROM f JOIN e ON e.pid = f.pid AND e.n = f.n + 1)"""


@query(_LEVELS + " SELECT pid, seq, level FROM f")
def w12_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.levels(syscalls(spark, sf_dir).selectExpr("pid", "seq", "k / 90D AS usage")).select("pid", "seq", "level")


@query(_LEVELS + " SELECT pid, seq, before, level FROM f WHERE level <> before")
def w12_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.transitions(control.levels(syscalls(spark, sf_dir).selectExpr("pid", "seq", "k / 90D AS usage"))).select("pid", "seq", "before", "level")


@query("""WITH RECURSIVE e AS (SELECT user_id AS pid, event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, CAST(floor(value) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 f(pid, seq, ts_ns, n, start_ns, cnt, size, emitted, prev_count, prev_bytes) AS (SELECT pid, seq, ts_ns, n, ts_ns, 1, bytes, true, 0, CAST(0 AS BIGINT) FROM e WHERE n = 1
  UNION ALL SELECT e.pid, e.seq, e.ts_ns, e.n, CASE WHEN e.ts_ns - f.start_ns <= 21600000000000 THEN f.start_ns ELSE e.ts_ns END, CASE WHEN e.ts_ns - f.start_ns <= 21600000000000 THEN f.cnt + 1 ELSE 1 END,
   CASE WHEN e.ts_ns - f.start_ns <= 21600000000000 THEN f.size + e.bytes ELSE e.bytes END, e.ts_ns - f.start_ns > 21600000000000, CASE WHEN e.ts_ns - f.start_ns > 21600000000000 AND f.cnt > 1 THEN f.cnt ELSE 0 END, CASE WHEN e.ts_ns - f.start_ns > 21600000000000 AND f.cnt > 1 THEN f.size ELSE 0 END
   FROM f JOIN e ON e.pid = f.pid AND e.n = f.n + 1)
 SELECT pid, seq, ts_ns, prev_count, prev_bytes FROM f WHERE emitted""")
def w14_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.coalesce_events(syscalls(spark, sf_dir), ["pid"], 6 * HOUR_NS)


@query("""h AS (SELECT ts_ns // 3600000000000 * 3600000000000 AS tick_ns, count(*) FILTER (WHERE t = 'error') AS d, count(*) AS f FROM s GROUP BY 1), o AS (SELECT *, CAST((tick_ns - lag(tick_ns) OVER (ORDER BY tick_ns)) // 1000000 AS BIGINT) AS window_ms FROM h)
 SELECT tick_ns, d AS dropped, f AS frames, printf('%.6f', d / (d + f)) AS loss_ratio, window_ms, 'n1' AS node FROM o WHERE d > 0""")
def a16_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = syscalls(spark, sf_dir).groupBy(F.expr(f"ts_ns div {HOUR_NS} * {HOUR_NS}").alias("tick_ns")).agg(F.count_if(F.col("t") == "error").alias("d"), F.count("*").alias("f"))
    upto = "OVER (ORDER BY tick_ns ROWS UNBOUNDED PRECEDING)"
    return control.overflow(ticks.selectExpr("tick_ns", f"sum(d) {upto} AS dropped", f"sum(f) {upto} AS frames"), "n1")


@query(plain("SELECT t, count(*) FILTER (WHERE k < 50) * 1.0 / count(*) AS ratio, 0.0 AS nothing FROM s GROUP BY t"))
def a17_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).groupBy("t").agg(F.count_if(F.col("k") < 50).alias("a"), F.count("*").alias("b"))
    return rows.select("t", control.ratio(F.col("a"), F.col("b")).alias("ratio"), control.ratio(F.col("a"), F.lit(0)).alias("nothing"))


_REQUESTS = "q AS (SELECT seq, 'Kind' || (k % 3) AS kind, 'p' || (k % 10) AS name, CASE WHEN k % 7 = 0 THEN 'delete' ELSE 'apply' END AS action, k % 5 <> 0 AS valid FROM s)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syscalls(spark, sf_dir).selectExpr("seq", "concat('Kind', k % 3) AS kind", "concat('p', k % 10) AS name", "IF(k % 7 = 0, 'delete', 'apply') AS action", "k % 5 <> 0 AS valid")


@query(_REQUESTS + " SELECT kind, CASE WHEN valid THEN 'ok' ELSE 'rejected' END AS result, count(*) AS n FROM q GROUP BY 1, 2")
def a19_policy_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.outcomes(_requests(spark, sf_dir))


@query(_REQUESTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY seq DESC) AS n FROM q WHERE valid) SELECT seq, kind, name, action, valid FROM r WHERE n = 1 AND action <> 'delete'")
def p6_o4_policy_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.apply_all(_requests(spark, sf_dir))


@query(plain("SELECT name, count(*) AS n FROM s GROUP BY name ORDER BY n DESC, name LIMIT 5"))
def a20_ranked_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.counts(syscalls(spark, sf_dir)).orderBy(F.desc("n"), "name").limit(5)


# --- frames, logs, sinks -------------------------------------------------------

@query("""p AS (SELECT *, CASE t WHEN 'view' THEN 'enter' WHEN 'purchase' THEN 'exit' ELSE 'unary' END AS phase FROM s WHERE t IN ('view', 'purchase', 'signup') AND NOT (t = 'view' AND k % 9 = 0)),
 x AS (SELECT *, lag(phase) OVER w AS pp, lag(ts_ns) OVER w AS pts, lag(k) OVER w AS pk FROM p WHERE phase <> 'unary' WINDOW w AS (PARTITION BY pid, k % 3 ORDER BY seq))
 SELECT pid AS host_tid, k % 3 AS syscall_id, seq, CASE WHEN pp = 'enter' THEN pts ELSE ts_ns END AS ts_ns, k - 5 AS retval, CASE WHEN pp = 'enter' THEN pk ELSE k END AS payload, coalesce(pp = 'enter', false) AS paired FROM x WHERE phase = 'exit'
 UNION ALL SELECT pid, k % 3, seq, ts_ns, k - 5, k, false FROM p WHERE phase = 'unary'""")
def s7_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).where("t IN ('view', 'purchase', 'signup')")
    frames = rows.selectExpr("pid AS host_tid", "k % 3 AS syscall_id", "seq", "ts_ns", "CASE t WHEN 'view' THEN 'enter' WHEN 'purchase' THEN 'exit' ELSE 'unary' END AS phase", "IF(t = 'view' AND k % 9 = 0, 0, 1) AS n_args", "k - 5 AS retval", "k AS payload")
    return pairing.pair(frames)


@query("g AS (SELECT pid % 4 AS cpu, seq, seq - lag(seq) OVER (PARTITION BY pid % 4 ORDER BY seq) - 1 AS gap FROM s WHERE k % 13 <> 0) SELECT cpu, CAST(sum(coalesce(greatest(gap, 0), 0)) AS BIGINT) AS lost FROM g GROUP BY cpu")
def s5_sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.sequence_gaps(syscalls(spark, sf_dir).where("k % 13 <> 0").selectExpr("pid % 4 AS cpu", "seq", "seq AS cpu_seq"))


@query(plain("SELECT seq, CASE WHEN k % 7 = 0 THEN '' ELSE 'str' || k END AS text, k % 7 = 0 AS missed FROM s"))
def s6_string_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir)
    words = rows.where("k % 7 <> 0").selectExpr("k AS hash", "concat('str', k) AS text").distinct()
    return wire.resolve_refs(rows.selectExpr("seq", "k AS hash"), words).select("seq", "text", "missed")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syscalls(spark, sf_dir).selectExpr("seq + 1 AS seq", "element_at(array('intent', 'deviation', 'raw'), k % 3 + 1) AS stream", "ts_ns", "IF(k % 5 = 0, '', container_id) AS container_id", "op AS body")


@query(plain("SELECT seq + 1 AS seq, op AS body FROM s WHERE k % 3 = 0 AND seq + 1 > 500"))
def s15_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir)
    return log.read_from(rows, 500, "intent").select("seq", "body")


@query("t AS (SELECT min(ts_ns) AS a, max(ts_ns) AS b FROM s) SELECT seq + 1 AS seq, op AS body FROM s, t WHERE k % 3 = 0 AND (k % 5 = 0 OR container_id = 'c4') AND ts_ns BETWEEN a + 86400000000000 AND b - 86400000000000")
def s16_container_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir)
    a, b = rows.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    return log.dump(rows, "c4", a + DAY, b - DAY).select("seq", "body")


@query(plain("SELECT seq + 1 AS seq, op AS body FROM s WHERE seq + 1 > 9000"))
def t5_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscribe.resume(_log(spark, sf_dir), 9000).select("seq", "body")


@query("g AS (SELECT seq // 1000 AS segment, max(ts_ns) AS end_ns, count(*) * 100 AS bytes FROM s GROUP BY 1), x AS (SELECT *, segment = (SELECT max(segment) FROM g) AS open_, (SELECT max(end_ns) FROM g) - end_ns > 20 * 86400000000000 AS old FROM g), k AS (SELECT *, sum(bytes) OVER (ORDER BY segment DESC) AS upto FROM x WHERE NOT (old AND NOT open_)) SELECT segment, 'ttl' AS reason FROM x WHERE old AND NOT open_ UNION ALL SELECT segment, 'size' FROM k WHERE upto > 350000 AND NOT open_")
def k4_log_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = syscalls(spark, sf_dir).groupBy(F.expr("seq div 1000").alias("segment")).agg(F.max("ts_ns").alias("end_ns"), (F.count("*") * 100).alias("bytes"))
    last = seg.agg(F.max("segment").alias("s"), F.max("end_ns").alias("t")).first()
    return log.collectable(seg.withColumn("open", F.col("segment") == last["s"]), last["t"], 20 * DAY, 350_000)


@query(plain("""SELECT '{"pid":' || pid || ',"op":"' || op || '","ts_ns":' || ts_ns || '}' AS value FROM s WHERE op = 'connect'"""))
def k1_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.as_json(syscalls(spark, sf_dir).where("op = 'connect'").select("pid", "op", "ts_ns"))


@query(plain("SELECT k % 4 AS shard, seq AS file, ts_ns AS modified_ns FROM (SELECT *, row_number() OVER (PARTITION BY k % 4 ORDER BY ts_ns DESC, seq DESC) AS n FROM s) WHERE n <= 4"))
def k2_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.newest_files(syscalls(spark, sf_dir).selectExpr("k % 4 AS shard", "seq AS file", "ts_ns AS modified_ns"))


@query(plain("SELECT pid, arg_max(op, seq) AS op, max(seq) AS seq FROM s GROUP BY pid"))
def k7_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).select("pid", "op", "seq")
    return sinks.upsert(rows.where("seq < 5000"), rows.where("seq >= 5000"), ["pid"])


# --- policies, sets, dictionaries ---------------------------------------------

_HOOKS = """w(nth, kind, hook, priority, fallback) AS (VALUES (0, 'syscall_tracepoint', 'execve', 'critical', ''), (1, 'syscall_tracepoint', 'openat2', 'normal', 'syscall_tracepoint:openat'), (2, 'lsm_bpf', 'file_open', 'normal', 'kprobe:file_open'), (3, 'lsm_bpf', 'task_kill', 'normal', ''), (4, 'kprobe', 'odd', 'normal', 'nonsense')),
 c(kind, hook, ok, why) AS (VALUES ('syscall_tracepoint', 'execve', true, ''), ('syscall_tracepoint', 'openat', true, ''), ('lsm_bpf', 'task_kill', false, 'no_btf'), ('kprobe', 'file_open', false, 'no_symbol'))"""


@query("WITH " + _HOOKS + """ SELECT w.nth, w.kind, w.hook, w.priority, '' AS sample, CASE WHEN c.ok THEN 'attach' WHEN b.ok THEN 'fallback' ELSE 'skip' END AS status, CASE WHEN c.ok THEN w.kind || ':' || w.hook WHEN b.ok THEN w.fallback ELSE '' END AS attached,
  CASE WHEN coalesce(c.ok, false) OR coalesce(b.ok, false) THEN '' WHEN w.fallback = '' THEN coalesce(c.why, 'hook_not_found') || ' (no fallback)' WHEN w.fallback NOT LIKE '%:%' THEN 'malformed fallback ' || w.fallback ELSE 'fallback ' || w.fallback || ' also unavailable' END AS reason
 FROM w LEFT JOIN c ON c.kind = w.kind AND c.hook = w.hook LEFT JOIN c b ON b.kind || ':' || b.hook = w.fallback""")
def j13_resolve_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = policy.Subscription("s", syscalls=["execve", "openat2"], lsm=["file_open", "task_kill"], kprobes=["odd"], critical=["execve"], fallback={"openat2": "syscall_tracepoint:openat", "file_open": "kprobe:file_open", "odd": "nonsense"}, on_missing="fallback")
    caps = spark.createDataFrame([("syscall_tracepoint", "execve", True, ""), ("syscall_tracepoint", "openat", True, ""), ("lsm_bpf", "task_kill", False, "no_btf"), ("kprobe", "file_open", False, "no_symbol")], "kind string, hook string, available boolean, reason string")
    return policy.resolve(policy.wants(spark, sub), caps, sub.on_missing)


@query("SELECT * FROM (VALUES ('forensics-full', 50), ('network-only', 9), ('security-minimal', 5), ('security-standard', 22)) AS t(preset, hooks)")
def p4_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, len(s.syscalls) + len(s.lsm)) for n in policy.PRESETS if (s := policy.preset(n))]
    return spark.createDataFrame(rows, "preset string, hooks long")


@query(plain("SELECT path AS item FROM s WHERE pid % 2 = 0 AND path IS NOT NULL UNION SELECT peer FROM s WHERE pid % 2 = 1"))
def u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir)
    return rows.where("pid % 2 = 0 AND path IS NOT NULL").select(F.col("path").alias("item")).union(rows.where("pid % 2 = 1").select("peer")).distinct()


@query(plain("SELECT DISTINCT name AS item FROM s WHERE pid % 3 = 0 AND name NOT IN (SELECT name FROM s WHERE pid = 4)"))
def u2_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).withColumnRenamed("name", "item")
    return rows.where("pid % 3 = 0").select("item").distinct().join(rows.where("pid = 4").select("item"), "item", "left_anti").orderBy("item")


@query(plain("SELECT count(*) AS n FROM (SELECT name FROM s WHERE pid = 4 INTERSECT SELECT name FROM s WHERE pid = 5)"))
def u3_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).select("pid", "name")
    return rows.where("pid = 4").select("name").intersect(rows.where("pid = 5").select("name")).agg(F.count("*").alias("n"))


@query(plain("SELECT container_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM s GROUP BY container_id"))
def o3_sorted_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syscalls(spark, sf_dir).groupBy("container_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query("""SELECT event_id AS seq, CASE k WHEN 0 THEN 'process' WHEN 1 THEN 'file' WHEN 2 THEN 'network' ELSE 'default' END AS category, CASE k WHEN 0 THEN 'execute' WHEN 1 THEN 'open_write' WHEN 2 THEN 'connect' WHEN 3 THEN 'execve' ELSE 'syscall_999' END AS operation,
  CASE k WHEN 0 THEN '/bin/x' || u WHEN 1 THEN '/data/y' || u WHEN 2 THEN '1.0.0.10:80' ELSE '' END AS resource, CASE WHEN k < 3 THEN CASE k WHEN 0 THEN 'argv=a b' WHEN 1 THEN 'dirfd=-100;flags=65' ELSE 'fd=3' END ELSE '' END AS named
 FROM (SELECT event_id, user_id AS u, CAST(json_extract(props, '$.k') AS INT) % 5 AS k FROM events)""")
def s8_s9_mapped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import mapping

    rows = syscalls(spark, sf_dir).selectExpr("seq", "pid", "k % 5 AS m")
    arg = lambda t, v, p="NULL": f"named_struct('type', '{t}', 'value', {v}, 'parts', CAST({p} AS array<string>))"
    args = f"""CASE m WHEN 0 THEN array({arg('resource', "concat('/bin/x', pid)")}, {arg('strarr', "''", "array('a', 'b')")}) WHEN 1 THEN array({arg('int', "'-100'")}, {arg('resource', "concat('/data/y', pid)")}, {arg('int', "'65'")})
        WHEN 2 THEN array({arg('int', "'3'")}, {arg('int', "'2'")}, {arg('uint', "'167772161'")}, {arg('uint', "'80'")}) WHEN 4 THEN array({arg('int', "'1'")}) ELSE filter(array({arg('int', "'1'")}), x -> false) END AS args"""
    frames = rows.selectExpr("seq", "element_at(array(59, 257, 42, 59, 999), m + 1) AS syscall_id", args, "0 AS retval")
    found = mapping.map_frames(mapping.named(frames, mapping.call_names(spark)))
    return found.select("seq", "category", "operation", "resource", F.array_join(F.transform("named", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ";").alias("named"))
