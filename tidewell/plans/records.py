"""Queries: counted state, hashes, frames, documents, identifiers, what a node can observe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars
from ..functions.hashes import BASIS32, PRIME32, fnv1a32, seeds
from ..operators import baseline, capability, contract, control, interning, intents
from ..sources import dimensions, documents, log, sinks, wire
from ..sources.events import syscalls, table
from ..sources.frames import frames_of
from .intents import _FILES, IDLE
from .registry import plain, query

HOUR_NS = intents.HOUR_NS


def _fnv(text: str, first: tuple[int, ...] = ()) -> str:
    """SQL: FNV-1a 32 of the bytes `first` and then of an ASCII text."""
    start = f"[CAST({BASIS32} AS UBIGINT)" + "".join(f", CAST({b} AS UBIGINT)" for b in first) + "]"
    return f"list_reduce(list_concat({start}, list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS UBIGINT))), lambda h, b: (xor(h, b) * {PRIME32}) % 4294967296)"


# --- counted state ---------------------------------------------------------------

@query(_FILES + """, n AS (SELECT pid, epoch, fd, sid, unnest(string_split(ids, ',')) AS id FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY pid, epoch, fd, sid ORDER BY CAST(id AS BIGINT) DESC) AS k FROM n)
 SELECT pid, epoch, fd, sid, string_agg(id, ',' ORDER BY CAST(id AS BIGINT)) AS ids FROM r WHERE k <= 2 GROUP BY pid, epoch, fd, sid""")
def a4_capped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the newest two events of each file session."""
    found = intents.file_sessions(syscalls(spark, sf_dir), IDLE, cap=2)
    return found.select("pid", "epoch", "fd", "sid", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


_WIDTH, _DEPTH = baseline.sketch_size(0.01, 0.01)


@query(f"""c AS (SELECT name, count(*) AS n FROM s GROUP BY name),
 b AS (""" + " UNION ALL ".join(f"SELECT name, n, {k} AS cell_row, {_fnv('name', tuple(seed.to_bytes(4, 'little')))} % {_WIDTH} AS bucket FROM c" for k, seed in enumerate(seeds(_DEPTH))) + """),
 t AS (SELECT cell_row, bucket, least(sum(n), 4294967295) AS total FROM b GROUP BY cell_row, bucket)
 SELECT b.name, any_value(b.n) AS n, CAST(min(total) AS BIGINT) AS estimate FROM b JOIN t ON t.cell_row = b.cell_row AND t.bucket = b.bucket GROUP BY b.name""")
def a6_sketch_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch estimates beside exact counts; the sketch is merged from two halves of the stream."""
    rows = syscalls(spark, sf_dir)
    exact = baseline.counts(rows)
    halves = [baseline.sketch(baseline.counts(rows.where(f"seq % 2 = {k}")), _WIDTH, _DEPTH) for k in (0, 1)]
    cells = baseline.merge_sketches(halves[0].unionByName(halves[1]))
    return exact.join(baseline.sketch_estimate(cells, exact, _WIDTH, _DEPTH), "name")


@query(plain("SELECT pid % 8 AS ring, CAST(sum(k) AS BIGINT) AS dropped FROM s WHERE t = 'error' GROUP BY pid % 8"))
def a18_ring_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.ring_drops(syscalls(spark, sf_dir).where("t = 'error'").selectExpr("pid AS cpu", "k AS n"))


@query(plain("SELECT * FROM (SELECT 'syscalls' AS key, count(*) AS total FROM s UNION ALL SELECT 'intents', count(*) FROM s WHERE op IN ('execute', 'open') UNION ALL SELECT 'frames_read', CAST(sum(k) AS BIGINT) FROM s)"))
def a20_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of the four fixed rows."""
    return control.totals(syscalls(spark, sf_dir).agg(F.count("*").alias("syscalls"), F.count_if(F.col("op").isin("execute", "open")).alias("intents"), F.sum("k").alias("frames_read"), F.count_if(F.col("t") == "error").alias("frames_dropped")), 3)


@query(plain("SELECT count(DISTINCT pid) AS processes, count(DISTINCT container_id) AS containers, count(DISTINCT path) AS paths, count(DISTINCT peer) AS peers FROM s"))
def a21_state_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.state_sizes(syscalls(spark, sf_dir), processes="pid", containers="container_id", paths="path", peers="peer")


_GAP = 12 * HOUR_NS


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS pid, epoch_us(ts) * 1000 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS size FROM events WHERE event_type = 'signup'),
 f(pid, n, size, ran, due, late, now) AS (SELECT pid, n, size, ts, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), ts FROM e WHERE n = 1
  UNION ALL SELECT pid, n, size, CASE WHEN run THEN ts ELSE ran1 END, CASE WHEN run THEN due1 ELSE coalesce(due1, ran1 + {_GAP}) END, late1, CASE WHEN run THEN ts END
   FROM (SELECT *, ts - ran1 >= {_GAP} AS run FROM (SELECT e.pid, e.n, e.size, e.ts, CASE WHEN f.due <= e.ts THEN f.due ELSE f.ran END AS ran1, CASE WHEN f.due <= e.ts THEN NULL ELSE f.due END AS due1, CASE WHEN f.due <= e.ts THEN f.due END AS late1
     FROM f JOIN e ON e.pid = f.pid AND e.n = f.n + 1)))
 SELECT pid, now AS run_ns, false AS deferred FROM f WHERE now IS NOT NULL UNION ALL SELECT pid, late, true FROM f WHERE late IS NOT NULL UNION ALL SELECT pid, due, true FROM f WHERE n = size AND due IS NOT NULL""")
def w15_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.debounce(syscalls(spark, sf_dir).where("op = 'execute'"), ["pid"], _GAP)


# --- hashes, frames, logs ----------------------------------------------------------

@query(plain(f"SELECT CAST({_fnv("'i' || seq")} % 4 AS INTEGER) AS shard, count(*) AS n FROM s GROUP BY 1"))
def k2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a shard."""
    return sinks.sharded(syscalls(spark, sf_dir).selectExpr("concat('i', seq) AS intent_id"), "intent_id", 4).groupBy("shard").agg(F.count("*").alias("n"))


@query(plain(f"SELECT name, CAST({_fnv('name')} AS BIGINT) AS hash FROM (SELECT DISTINCT name FROM s)"))
def x13_fnv32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syscalls(spark, sf_dir).select("name").distinct().select("name", fnv1a32(F.col("name")).alias("hash"))


@query("""b AS (SELECT *, sum(CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY pid % 4 ORDER BY seq) AS base FROM s),
 c AS (SELECT *, first(pid) OVER w AS base_pid, CASE WHEN base > 0 THEN first(ts_ns) OVER w + 1000 * (row_number() OVER w - 1) ELSE 1000 * row_number() OVER w END AS moment FROM b WINDOW w AS (PARTITION BY pid % 4, base ORDER BY seq))
 SELECT seq, pid % 4 AS cpu, CAST(moment AS BIGINT) AS ts, CASE WHEN base > 0 THEN base_pid END AS pid, k AS syscall_id, k - 5 AS retval, CASE WHEN k % 3 <> 0 THEN peer ELSE CAST(bytes AS VARCHAR) END AS first_arg, seq AS cpu_seq,
  CASE WHEN base = 0 THEN 'compact frame before its base' END AS error FROM c""")
def s1_s4_decoded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames made of the events, every third a compact one, decoded again."""
    decoded = wire.expand_compact(wire.decode_frames(frames_of(syscalls(spark, sf_dir))))
    whole = [F.col(c).cast("long").alias(c) for c in ("cpu", "ts", "pid", "syscall_id", "retval")]
    return decoded.select("seq", *whole, F.col("args")[0]["value"].alias("first_arg"), F.col("cpu_seq").cast("long").alias("cpu_seq"), "error")


@query(plain("SELECT row_number() OVER (ORDER BY ts_ns, seq) AS seq, CAST(seq AS VARCHAR) AS body FROM s"))
def k3_appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stream appended to a log in two batches, and read back."""
    rows = syscalls(spark, sf_dir)
    path = f"{scratch.shared_dir(spark)}/tidewell-{spark.sparkContext.applicationId}/log-{sf_dir.strip('/').replace('/', '-')}-{scratch.written(spark)}"
    # Arrival: the rank in (time, sequence) order.
    from ..operators.numbering import numbered

    batch = numbered(rows.selectExpr("'intent' AS stream", "ts_ns", "container_id", "string(seq) AS body", "seq AS own"), ["ts_ns", "own"], "arrival")
    n = batch.count()
    log.append(batch.where(F.col("arrival") <= n // 2), path, 0)
    log.append(batch.where(F.col("arrival") > n // 2), path, n // 2)
    return log.read(spark, path).select("seq", "body")


# --- documents -----------------------------------------------------------------------

_ITEMS = """i AS (SELECT DISTINCT container_id AS profile_id, category, item FROM (SELECT container_id, 'exec' AS category, binary_ AS item FROM s WHERE op = 'execute' UNION ALL SELECT container_id, 'file', path FROM s WHERE op = 'open'
 UNION ALL SELECT container_id, 'file.write', path FROM s WHERE op = 'open' AND hint IN ('openw', 'openrw') UNION ALL SELECT container_id, 'peer', peer FROM s WHERE op = 'connect' UNION ALL SELECT container_id, 'syscall', name FROM s))"""


@query(_ITEMS + ", h AS (SELECT container_id AS profile_id, count(*) AS samples FROM s GROUP BY 1) SELECT profile_id, samples, category, item FROM h JOIN i USING (profile_id)")
def k10_s17_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile a container, written as documents and read back."""
    rows = syscalls(spark, sf_dir)
    parts = [("execute", None, "exec", "binary_"), ("open", None, "file", "path"), ("open", "hint IN ('openw', 'openrw')", "file.write", "path"), ("connect", None, "peer", "peer"), (None, None, "syscall", "name")]
    items = [rows.where(f"op = '{op}'" if op else "true").where(also or "true").select(F.col("container_id").alias("profile_id"), F.lit(c).alias("category"), F.col(v).alias("item")) for op, also, c, v in parts]
    headers = rows.groupBy(F.col("container_id").alias("profile_id")).agg(F.count("*").alias("samples")).selectExpr("*", "'2024-01-01T00:00:00Z' AS learn_start", "'2024-01-02T00:00:00Z' AS learn_end", "0.5D AS confidence", "0.01D AS rarity_floor", "0.01D AS markov_floor")
    made = documents.profile_documents(headers, items[0].unionByName(items[1]).unionByName(items[2]).unionByName(items[3]).unionByName(items[4]))
    found, own = documents.read_profiles(made.select("body"))
    return found.select("profile_id", "samples").join(own, "profile_id")


@query("""o AS (SELECT DISTINCT path AS subject FROM s WHERE op = 'open'), f AS (SELECT 'observed_but_denied' AS kind, subject FROM o WHERE NOT regexp_matches(subject, '^/data/f1[^/]*$')
  UNION ALL SELECT 'unused_allowance', subject FROM (VALUES ('/data/f1*'), ('/never/*')) AS g(subject) WHERE NOT EXISTS (SELECT 1 FROM o WHERE regexp_matches(o.subject, '^' || replace(g.subject, '*', '[^/]*') || '$')))
 SELECT row_number() OVER (ORDER BY kind, subject) AS place, kind, subject FROM f""")
def o1_ordered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap report's findings with their places in its order."""
    from ..operators.numbering import numbered
    from ..schema import RULE

    rule = lambda **k: tuple({"category": "file.read", "path": "", "path_glob": "", "peer": "", "fqdn": "", "binary": "", "name": "", **k}.values())
    seen = syscalls(spark, sf_dir).where("op = 'open'").selectExpr("'file.read' AS category", "path", "'' AS path_glob", "'' AS peer", "'' AS fqdn", "'' AS binary", "'' AS name").distinct()
    found = contract.gap(seen, spark.createDataFrame([rule(path_glob="/data/f1*"), rule(path_glob="/never/*")], RULE))
    return numbered(contract.findings_in_order(found), ["kind", "category", "subject"], "place").select("place", "kind", "subject")


# --- identifiers, paths, names ---------------------------------------------------------

_TTL = 24 * HOUR_NS


@query(f"""m AS (SELECT seq, name, ts_ns, k % 5 = 0 AS b, CASE WHEN ts_ns - lag(ts_ns) OVER w < {_TTL} THEN 0 ELSE 1 END AS new FROM (SELECT seq, 'n' || (k % 50) || '-' || pid AS name, ts_ns, k FROM s) WINDOW w AS (PARTITION BY name ORDER BY seq)),
 y AS (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY seq) AS epoch FROM m), f AS (SELECT *, min(CASE WHEN NOT b THEN seq END) OVER (PARTITION BY name, epoch) AS ok FROM y),
 a AS (SELECT seq AS tried, row_number() OVER (ORDER BY seq) AS id FROM f WHERE ok IS NULL OR seq <= ok)
 SELECT seq, name AS text, CASE WHEN seq >= ok THEN id ELSE 0 END AS id, coalesce(seq = ok, false) AS fresh FROM f LEFT JOIN a ON tried = ok""")
def t9_interning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in the order of first sight; a day unseen is forgotten, every fifth sight finds the channel full."""
    rows = syscalls(spark, sf_dir).selectExpr("seq", "ts_ns", "concat('n', k % 50, '-', pid) AS text", "k % 5 = 0 AS backlogged")
    return interning.intern(rows, _TTL)


@query("""r AS (SELECT seq, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '/a/./b//c' || k WHEN 2 THEN 'rel/../x' || k WHEN 3 THEN 'y' || k ELSE 'long/' || repeat('z', k) END AS raw, CASE WHEN k % 2 = 0 THEN -100 ELSE 5 END AS dirfd,
   CASE WHEN k % 5 <> 0 THEN '/dir/d' || pid END AS fd_path, k % 7 = 0 AS sock, CASE WHEN k % 4 <> 0 THEN '/home/./u' END AS cwd FROM s),
 p AS (SELECT *, CASE WHEN raw = '' AND dirfd = -100 THEN 'empty_input' WHEN raw = '' THEN CASE WHEN fd_path IS NULL THEN 'fd_table_miss' END WHEN raw LIKE '/%' THEN NULL
    WHEN dirfd = -100 THEN CASE WHEN cwd IS NULL THEN 'proc_lookup_failed' END WHEN fd_path IS NULL OR sock THEN 'fd_table_miss' END AS early FROM r),
 w AS (SELECT *, CASE WHEN early IS NOT NULL THEN NULL WHEN raw = '' THEN fd_path WHEN raw LIKE '/%' THEN replace(raw, '/./b//', '/b/')
    ELSE (CASE WHEN dirfd = -100 THEN '/home/u' ELSE fd_path END) || '/' || replace(raw, 'rel/../', '') END AS whole FROM p)
 SELECT seq, CASE WHEN early IS NULL AND length(whole) <= 60 THEN whole ELSE '' END AS path, CASE WHEN early IS NOT NULL THEN early WHEN length(whole) > 60 THEN 'path_too_long' ELSE '' END AS reason,
  CASE WHEN early = 'empty_input' THEN '' WHEN early IS NOT NULL THEN CASE WHEN length(raw) <= 32 THEN raw ELSE '...' || right(raw, 29) END WHEN length(whole) > 60 THEN '...' || right(whole, 29) ELSE '' END AS hint FROM w""")
def x11_resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syscalls(spark, sf_dir).selectExpr(
        "seq", "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN concat('/a/./b//c', k) WHEN 2 THEN concat('rel/../x', k) WHEN 3 THEN concat('y', k) ELSE concat('long/', repeat('z', k)) END AS raw", "IF(k % 2 = 0, -100, 5) AS dirfd",
        "CASE WHEN k % 5 <> 0 THEN concat('/dir/d', pid) END AS fd_path", "k % 7 = 0 AS sock", "CASE WHEN k % 4 <> 0 THEN '/home/./u' END AS cwd",
    )
    found = scalars.resolved_path(F.col("raw"), F.col("dirfd"), F.col("fd_path"), F.col("sock"), F.col("cwd"), 60)
    return rows.select("seq", found.alias("r")).select("seq", "r.path", "r.reason", "r.hint")


@query(plain("""SELECT seq, ts_ns AS start_ns, 'host' || k AS query, ip AS addr, CASE WHEN pid % 3 = 1 THEN 'pod' || (pid % 10) ELSE '' END AS pod, CASE WHEN pid % 3 = 1 THEN 'box' || (pid % 10) ELSE container_id END AS container_id, 1 AS severity
 FROM s WHERE op = 'connect' AND k % 4 <> 0"""))
def t4_dns_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS answers as intents; a third of the cgroups is known."""
    rows = syscalls(spark, sf_dir).where("op = 'connect'").selectExpr("seq", "ts_ns", "IF(k % 8 = 0, '', concat('host', k)) AS query", "IF(k % 8 = 4, '', ip) AS addr", "'1' AS rtype", "pid AS cgroup_id", "container_id", "'' AS pod", "'' AS namespace")
    known = syscalls(spark, sf_dir).select("pid").distinct().where("pid % 3 = 1").selectExpr("pid AS cgroup_id", "concat('box', pid % 10) AS container_id", "concat('pod', pid % 10) AS pod", "'ns' AS namespace")
    found = dimensions.dns_intents(rows, known)
    return found.selectExpr("seq", "start_ns", "attributes['query'] AS query", "attributes['addr'] AS addr", "meta.pod AS pod", "meta.container_id AS container_id", "severity")


@query(plain("SELECT name AS probe, 'ok' AS state, '' AS warning FROM (SELECT DISTINCT 'syscall_tracepoint/' || name AS name FROM s) UNION ALL SELECT 'lsm_bpf/' || h, 'fallback', 'lsm_bpf/' || h || ': lsm=bpf boot param missing' FROM (VALUES " + ", ".join(f"('{h}')" for h in capability.LSM_HOOKS) + ") AS l(h) UNION ALL SELECT 'kprobe/' || h, CASE WHEN ok THEN 'ok' ELSE 'missing' END, CASE WHEN ok THEN '' ELSE 'kprobe/' || h || ': " + capability.NO_SYMBOL + "' END FROM (SELECT h, length(h) % 2 = 0 AS ok FROM (VALUES " + ", ".join(f"('{h}')" for h in capability.KPROBES) + ") AS k(h))"))
def p9_s19_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node whose tracepoints are the stream's names, with every other symbol and no BPF module: its report."""
    symbols = spark.createDataFrame([(k,) for k in capability.KPROBES if len(k) % 2 == 0] + [("other",)], "name string")
    return capability.diagnose(capability.discover(syscalls(spark, sf_dir).select("name"), symbols, ["lockdown", "yama"]))


@query(plain("SELECT pid % 16 AS pid_ns, 1 + pid % 3 AS mnt_ns, min(pid) AS pid FROM s GROUP BY 1, 2"))
def s18_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = syscalls(spark, sf_dir).select("pid").distinct().selectExpr("pid", "concat('pid:[', pid % 16, ']') AS pid_link", "concat('mnt:[', 1 + pid % 3, ']') AS mnt_link")
    odd = links.limit(0).unionByName(spark.createDataFrame([(0, "pid:[x]", "mnt:[1]"), (0, None, "mnt:[1]")], "pid long, pid_link string, mnt_link string"))
    return dimensions.namespace_index(spark, links.unionByName(odd))


@query(plain("SELECT 'w' || (pid % 20) AS workload, CAST(arg_max(k, seq) AS VARCHAR) AS profile_id FROM s WHERE k % 5 IN (0, 1, 2) GROUP BY 1 HAVING arg_max(k % 5, seq) = 0"))
def t11_p11_active_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile in force of each workload: activations, deactivations, resets and others in stream order."""
    rows = syscalls(spark, sf_dir).selectExpr("seq", "concat('w', pid % 20) AS workload", "element_at(array('activate', 'deactivate', 'reset', 'promote', 'learn'), int(k % 5) + 1) AS action", "string(k) AS profile_id")
    return dimensions.active_model(rows)


@query("SELECT CAST(NULL AS VARCHAR) AS error, count(*) AS n FROM events WHERE event_id % 9 <> 0 HAVING count(*) > 0 UNION ALL SELECT 'broken ' || (event_id % 2), count(*) FROM events WHERE event_id % 9 = 0 GROUP BY 1")
def s10_t8_pump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources as one: sound rows counted, broken ones by what is wrong."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS seq", "CASE WHEN event_id % 9 = 0 THEN concat('broken ', event_id % 2) END AS error")
    good, bad = dimensions.pumped([rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")])
    return good.select(F.lit(None).cast("string").alias("error")).groupBy("error").agg(F.count("*").alias("n")).unionByName(bad)
