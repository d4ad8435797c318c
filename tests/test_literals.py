"""Small cases with known answers, operator by operator."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import globs, hashes, scalars
from tidewell.operators import baseline, capability, contract, control, correlate, enrich, graph, history, interning, intents, mapping, pairing, policy, subscribe
from tidewell.operators.asof import asof
from tidewell.sources import dimensions, documents, frames, log, sinks, wire

S = 1_000_000_000
EVENT = "seq long, ts_ns long, pid long, fd int, op string, path string, hint string, bytes long, peer string, binary_ string"


def events(spark, *rows):
    return spark.createDataFrame([(k, (r.get("ts", k)) * S, r.get("pid", 1), r.get("fd", 3), r["op"], r.get("path"), r.get("hint"), r.get("bytes", 0), r.get("peer"), r.get("binary")) for k, r in enumerate(rows)], EVENT)


def sessions(spark, *rows):
    return [r.asDict() for r in intents.file_sessions(events(spark, *rows), 100 * S).orderBy("start_ns").collect()]


def test_read_then_close(spark):
    (r,) = sessions(spark, dict(op="open", path="/etc/passwd", hint="openr"), dict(op="read", bytes=200), dict(op="read", bytes=300), dict(op="close"))
    assert (r["kind"], r["bytes_read"], r["confidence"], len(r["ids"])) == ("FileRead", 500, 1.0, 4)


@pytest.mark.parametrize("hint,kind", [("openr", "FileRead"), ("openw", "FileWrite"), ("openrw", "FileReadWrite"), ("", "FileAccess"), ("open", "FileAccess")])
def test_hints(spark, hint, kind):
    assert sessions(spark, dict(op="open", path="/a", hint=hint), dict(op="close"))[0]["kind"] == kind


def test_session_ends(spark):
    a, b = sessions(spark, dict(op="open", path="/a"), dict(op="read", bytes=1), dict(op="open", path="/b"), dict(op="close"))
    assert (a["path"], a["confidence"], b["path"], b["confidence"]) == ("/a", 0.7, "/b", 1.0)
    (r,) = sessions(spark, dict(op="open", path="/a", ts=1), dict(op="exit", ts=9))
    assert r["end_ns"] == 9 * S and r["confidence"] == 0.7
    assert sessions(spark, dict(op="close")) == []
    first, second = sessions(spark, dict(op="open", path="/a", ts=0), dict(op="read", bytes=2, ts=500))
    assert first["end_ns"] == 0 and second["path"] == "" and second["kind"] == "FileRead"


@pytest.mark.parametrize("glob,text,match", [("/var/log/app/*.log", "/var/log/app/a.log", True), ("/var/log/app/*.log", "/var/log/app/x/a.log", False), ("/a?c", "/abc", True), ("/a?c", "/a/c", False), ("/[a-c]x", "/bx", True), ("/[^a-c]x", "/bx", False), ("/[^a-c]x", "//x", False), (r"/\*", "/*", True), ("/[", "/[", False), ("a.b", "axb", False), ("*", "a\nb", True)])
def test_globs(spark, glob, text, match):
    df = spark.createDataFrame([(text, glob)], "t string, g string")
    assert df.select(F.col("t").rlike(globs.to_regex(glob))).first()[0] is match
    if not set("[\\") & set(glob) and "\n" not in text:
        assert df.where(F.col("t").isNotNull()).select(globs.regex_of(F.col("g")).alias("p"), "t").where("t rlike p").count() == int(match)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(scalars.ret_code(F.lit(v))) for v in (0, 5, -13)] == ["SUCCESS", "5", "-13"]
    assert one(scalars.cap_name(F.lit(21))) == "CAP_SYS_ADMIN" and one(scalars.cap_name(F.lit(40))) == "CAP_CHECKPOINT_RESTORE"
    assert one(scalars.clone_flags(F.lit(0x20000000 | 0x20000).cast("long"))) == "CLONE_NEWNS|CLONE_NEWPID"
    assert one(scalars.host_of(F.lit("[::1]:80"))) == "::1" and one(scalars.port_of(F.lit("[::1]:80"))) == "80" and one(scalars.host_of(F.lit("plain"))) == "plain"
    assert [one(scalars.clean_path(F.lit(p))) for p in ("/a/./b//../c", "/../x", "/", "//a/")] == ["/a/c", "/x", "/", "/a"]
    assert one(scalars.joined_path(F.lit("/a/b"), F.lit("../c"))) == "/a/c" and one(scalars.joined_path(F.lit("/a"), F.lit("/c"))) == "/c"
    assert one(scalars.path_tail(F.lit("x" * 40))) == "..." + "x" * 29
    assert one(scalars.container_of(F.lit("0::/system.slice/docker-" + "a" * 64 + ".scope"))) == "a" * 64 and one(scalars.container_of(F.lit("0::/user.slice"))) == ""
    assert one(scalars.pod_uid_of(F.lit("0::/kubepods.slice/kubepods-burstable-pod12_34.slice/x"))) == "12_34"
    assert one(scalars.severity_level(F.lit("nonsense"))) == 0 and one(scalars.argv(F.array(F.lit("a\tb"), F.lit("c\n")))) == "a b c "


def test_hashes(spark):
    def fnv(data, h, p, bits):
        for b in data:
            h = (h ^ b) * p % (1 << bits)
        return h

    words = ["", "a", "execve", "é" * 200]
    assert [int(x) for x in hashes.fnv32([w.encode() for w in words])] == [fnv(w.encode(), 2166136261, 16777619, 32) for w in words]
    assert [int(x) for x in hashes.fnv64([w.encode() for w in words])] == [fnv(w.encode()[:256], 0xCBF29CE484222325, 0x100000001B3, 64) for w in words]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(hashes.sketch_buckets(F.col("w"), 272, 5).alias("b")).collect()
    for w, r in zip(words, got):
        assert r.b == [fnv(((0x9E3779B9 + k * 0x85EBCA6B) & 0xFFFFFFFF).to_bytes(4, "little") + w.encode(), 2166136261, 16777619, 32) % 272 for k in range(5)]


def test_sketch(spark):
    assert baseline.sketch_size(0.01, 0.01) == (272, 5) and baseline.sketch_size(0.001, 0.001) == (2719, 7)
    counted = spark.createDataFrame([(f"k{k}", k + 1) for k in range(300)], "name string, n long")
    cells = baseline.sketch(counted, 20, 4)
    found = {r.name: r.estimate for r in baseline.sketch_estimate(cells, counted, 20, 4).collect()}
    assert all(found[f"k{k}"] >= k + 1 for k in range(300))
    twice = baseline.merge_sketches(cells.unionByName(cells))
    assert {r.name: r.estimate for r in baseline.sketch_estimate(twice, counted, 20, 4).collect()} == {k: 2 * v for k, v in found.items()}
    assert baseline.sketch(spark.createDataFrame([("a", 2**33)], "name string, n long"), 5, 1).first().n == 2**32 - 1


def test_markov(spark):
    calls = "openat read close openat read close openat close read close".split()
    rows = spark.createDataFrame([(k, 1, c) for k, c in enumerate(calls)], "seq long, pid long, name string")
    found = {(r.prev, r.name): r.prob for r in baseline.transitions(rows).collect()}
    assert found["openat", "read"] == pytest.approx(2 / 3) and found["openat", "close"] == pytest.approx(1 / 3) and ("read", "openat") not in found
    assert {(r.prev, r.name): r.n for r in baseline.transitions(rows, per_pid=False).collect()} == {k: round(v * {"openat": 3, "read": 3, "close": 3}[k[0]]) for k, v in found.items()}


def test_ptrace_is_rare_and_odd(spark):
    train = spark.createDataFrame([(k, 1, c) for k, c in enumerate("openat read close".split() * 200)], "seq long, pid long, name string")
    score = spark.createDataFrame([(0, 1, "openat"), (1, 1, "ptrace")], "seq long, pid long, name string")
    rare = baseline.rare(score, baseline.frequencies(train), 0.05).collect()
    odd = baseline.markov_anomalies(score, baseline.transitions(train), 0.10).collect()
    assert [(r.seq, r.score, r.evidence) for r in rare] == [(1, 1.0, "syscall=ptrace")] and [(r.seq, r.score, r.evidence) for r in odd] == [(1, 1.0, "openat->ptrace")]


def test_profiles(spark):
    heads = spark.createDataFrame([("b", 10, 1.0, 5, 9, 0.1), ("a", 30, 0.2, 2, 7, 0.1)], "profile_id string, samples long, confidence double, start_ns long, end_ns long, floor double")
    r = baseline.merge_headers(heads).first()
    assert (r.samples, r.start_ns, r.end_ns, r.profile_id) == (40, 2, 9, baseline.merged_id(["a", "b"])) and r.confidence == pytest.approx(0.4)
    with pytest.raises(Exception, match="different floors"):
        baseline.merge_headers(heads.withColumn("floor", F.col("samples") * 0.1)).collect()
    assert baseline.profile_id("i", "l") != baseline.profile_id("i", "m") and baseline.profile_id("i", "l", compat=True).startswith("e3b0c442")


def rules(spark, *rows):
    none = dict(path="", path_glob="", peer="", fqdn="", binary="", name="")
    return spark.createDataFrame([tuple({"category": c, **none, **v}.values()) for c, v in rows], "category string, path string, path_glob string, peer string, fqdn string, binary string, name string")


def test_syscall_gap(spark):
    seen = rules(spark, *(("syscalls", {"name": n}) for n in ("execve", "openat", "read")))
    may = rules(spark, *(("syscalls", {"name": n}) for n in ("openat", "write")))
    found = {(r.kind, r.subject) for r in contract.gap(seen, may, ("syscalls",)).collect()}
    assert found == {("observed_but_denied", "execve"), ("observed_but_denied", "read"), ("unused_allowance", "write")}
    r = contract.gap_summary(seen, may, ("syscalls",)).first()
    assert (r.observed, r.denied) == (3, 2) and r.coverage_percent == pytest.approx(100 / 3) and r.drift == pytest.approx(0.75)


def test_gap_of_four(spark):
    seen = rules(spark, ("exec", {"binary": "/bin/a"}), ("file.read", {"path": "/x"}), ("network.egress", {"peer": "1:1"}), ("capability", {"name": "CAP_A"}), ("file.write", {"path": "/log/a.log"}), ("exec", {"binary": "/ok"}))
    may = rules(spark, ("exec", {"binary": "/bin/b"}), ("exec", {"binary": "/ok"}), ("file.read", {"path": "/y"}), ("network.egress", {"peer": "2:2"}), ("capability", {"name": "CAP_B"}), ("file.write", {"path_glob": "/log/*.log"}))
    found = contract.gap(seen, may).collect()
    assert sum(r.kind == "observed_but_denied" for r in found) == 4 and sum(r.kind == "unused_allowance" for r in found) == 4
    assert {r.subject for r in found if r.category == "file.write"} == set()


def test_contract_documents(spark):
    doc = {"apiVersion": "x.io/v1", "kind": "BehaviorContract", "spec": {"process": {"exec": [{"binary": "/b"}, {"binary": "/a"}]}, "file": {"read": [{"pathGlob": "/g*"}, {"path": "/f"}]}, "network": {"egress": [{"peer": "1:1"}]}, "syscalls": ["read"]}}
    found = contract.parse(spark, json.dumps(doc)).collect()
    assert [r.binary for r in found if r.category == "exec"] == ["/a", "/b"] and [r.path or r.path_glob for r in found if r.category == "file.read"] == ["/f", "/g*"]
    with pytest.raises(ValueError):
        contract.parse(spark, json.dumps(doc | {"kind": "Other"}))
    with pytest.raises(ValueError):
        contract.rules_of(spark.createDataFrame([("exec", "/a")], "category string, item string"), 0.4, 0.5)


OBS = "seq long, ts_ns long, pid long, path string, inode long"


def test_correlations(spark):
    w = spark.createDataFrame([(1, 0, 1, "/tmp/x", 0xBEEF)], OBS)
    e = spark.createDataFrame([(2, 5 * S, 2, "/other", 0xBEEF), (3, 6 * S, 2, "/tmp/x", 0), (4, 20 * S, 2, "/tmp/x", 0xBEEF)], OBS)
    found = {r.seq: (r.kind, r.ref_seq) for r in correlate.written_then_executed(e, w, 10 * S).collect()}
    assert found == {2: ("file_written_then_executed", 1), 3: ("file_written_then_executed", 1)}
    assert correlate.written_then_executed(e.where("seq = 4"), w, 5 * S).count() == 0
    assert correlate.enabled({"a": None, "b": None}, None) == ["a", "b"] and correlate.enabled({"a": None}, []) == []


def test_asof_is_strict(spark):
    a = spark.createDataFrame([(1, 10, "k"), (2, 10, "k"), (3, 30, None)], "seq long, ts_ns long, key string")
    b = spark.createDataFrame([(1, 10, "k", "same"), (0, 9, "k", "before")], "seq long, ts_ns long, key string, v string")
    assert {r.seq: r.r_v for r in asof(a, b, ["key"], ["v"]).collect()} == {1: "before", 2: "same", 3: None}


def test_asof_in_ranges(spark):
    """A hot key dealt into ranges of time matches as in one piece, null keys and empty ranges too."""
    rng = random.Random(8)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    a = spark.createDataFrame([(k, rng.randrange(1000), key()) for k in range(400)], "seq long, ts_ns long, key string")
    b = spark.createDataFrame([(1000 + k, rng.choice([rng.randrange(1000), rng.randrange(50)]), key(), f"v{k}") for k in range(60)], "seq long, ts_ns long, key string, v string")
    whole = sorted((r.seq, str(r.r_v), str(r.r_at)) for r in asof(a, b, ["key"], ["v"]).collect())
    for ranges in (2, 7, 30):
        assert sorted((r.seq, str(r.r_v), str(r.r_at)) for r in asof(a, b, ["key"], ["v"], ranges=ranges).collect()) == whole
    assert len({v for _, v, _ in whole}) > 20


def test_levels(spark):
    usage = spark.createDataFrame([(1, k, u) for k, u in enumerate((0.70, 0.85, 0.30, 0.30, 2.0, 0.5))], "pid long, seq long, usage double")
    assert [r.level for r in control.levels(usage).orderBy("seq").collect()] == [1, 2, 1, 0, 3, 3]
    rng = random.Random(1)
    many = spark.createDataFrame([(rng.randrange(3), k, rng.random()) for k in range(500)], "pid long, seq long, usage double")
    want, level = [], {}
    for r in many.orderBy("seq").collect():
        now = level.get(r.pid, 0)
        now = 3 if r.usage >= 0.95 else max(now, 2) if r.usage >= 0.8 else max(now, 1) if r.usage >= 0.6 else max(now - 1, 0) if r.usage < 0.4 else now
        level[r.pid] = now
        want.append((r.pid, r.seq, r.usage, now))
    assert sorted(map(tuple, control.levels(many).collect())) == sorted(want)


def test_coalescing_is_anchored(spark):
    ms = 1_000_000
    rows = spark.createDataFrame([(k, t * ms, 1, 10) for k, t in enumerate((0, 60, 100, 101, 150, 300))], "seq long, ts_ns long, pid long, bytes long")
    got = [(r.seq, r.prev_count, r.prev_bytes) for r in control.coalesce_events(rows, ["pid"]).orderBy("seq").collect()]
    assert got == [(0, 0, 0), (3, 3, 30), (5, 2, 20)]
    runs = [(r.run_ns // ms, r.deferred) for r in control.debounce(spark.createDataFrame([(1, t * ms) for t in (0, 100, 200, 600)], "pid long, ts_ns long"), ["pid"]).orderBy("run_ns").collect()]
    assert runs == [(0, False), (250, True), (600, False)]


EDGE = "seq long, edge_id string, kind string, src string, dst string, ts_ns long, session_id string"


def test_graph(spark):
    g = spark.createDataFrame([(1, "a", "FORK", "1", "10", 0, ""), (2, "b", "EXEC", "10", "20", 0, ""), (3, "c", "FORK", "20", "30", 0, ""), (4, "d", "FORK", "99", "30", 0, ""), (5, "e", "IPC_CONNECT", "30", "p", 0, ""), (6, "f", "FILE_TOUCH", "30", "q", 0, "")], EDGE)
    nodes = lambda *a: [r.node for r in graph.query(g, *a).collect()]
    assert nodes("30", "lineage") == ["20", "10", "1"] and nodes("30", "peers") == ["p"] and nodes("30", "touches") == ["q"] and nodes("10", "reaches", 2) == ["20", "30"]
    loop = spark.createDataFrame([(1, "a", "EXEC", "a", "b", 0, ""), (2, "b", "EXEC", "b", "a", 0, "")], EDGE)
    assert [r.node for r in graph.query(loop, "b", "lineage").collect()] == ["a"]
    with pytest.raises(ValueError):
        graph.query(g, "30", "nonsense")


def test_pairing(spark):
    rows = [(1, 7, 0, "enter", 1, 0, "a"), (1, 7, 1, "exit", 0, 5, ""), (1, 7, 2, "exit", 0, 6, "own"), (1, 7, 3, "enter", 0, 0, "x"), (1, 7, 4, "enter", 1, 0, "old"), (1, 7, 5, "enter", 1, 0, "new"), (1, 7, 6, "exit", 0, 9, ""), (2, 7, 7, "unary", 0, 1, "u")]
    df = spark.createDataFrame([(t, s, q, q * 10, p, n, r, v) for t, s, q, p, n, r, v in rows], "host_tid long, syscall_id int, seq long, ts_ns long, phase string, n_args int, retval int, payload string")
    assert {r.seq: (r.ts_ns, r.retval, r.payload, r.paired) for r in pairing.pair(df).collect()} == {1: (0, 5, "a", True), 2: (20, 6, "own", False), 6: (50, 9, "new", True), 7: (70, 1, "u", False)}


def test_wire(spark):
    import struct

    for v in (0, 1, 127, 128, 300, 2**32 - 1, 2**64 - 1):
        raw = wire.encode_varint(v)
        assert wire.decode_varint(raw, 0, 10) == (v, len(raw))
    with pytest.raises(ValueError):
        wire.decode_varint(b"\xff" * 11, 0, 10)
    array = struct.pack("<I", wire.STR_ARRAY) + frames.string_arg(wire.STR, "ls") + frames.string_arg(wire.STR, "-l") + struct.pack("<I", 0)
    full = frames.full_frame([frames.string_arg(wire.RESOURCE, "/bin/ls\0\0"), array, struct.pack("<Ii", wire.INT, -5), struct.pack("<I", wire.CPU_SEQ) + wire.encode_varint(9)], cpu=2, ts=1000, pid=77, syscall_id=59, cgroup_id=2**64 - 1)
    assert wire.HEADER.size == 72 and wire.COMPACT.size == 16
    raws = [full, frames.compact_frame([struct.pack("<I", wire.VAR64) + wire.encode_varint(300)], 2, 50, 0, 10), frames.compact_frame([], 2, 25, 1, 11), frames.compact_frame([], 3, 1, 1, 1), full[:90], b"\x01", frames.full_frame([struct.pack("<I", 99)], cpu=2, ts=5)]
    df = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(raws)], "seq long, raw binary")
    rows = {r.seq: r for r in wire.expand_compact(wire.decode_frames(df)).collect()}
    assert [a.value for a in rows[0].args] == ["/bin/ls", "", "-5"] and rows[0].args[1].parts == ["ls", "-l"] and rows[0].cpu_seq == 9 and rows[0].cgroup_id == -1
    assert (rows[1].ts, rows[1].pid, rows[1].syscall_id, rows[1].retval, rows[1].event_type) == (1050, 77, 0, 10, wire.UNARY_TYPE) and rows[2].ts == 1075
    assert rows[3].error and rows[4].error and rows[4].pid == 77 and "0x63" in rows[6].error and 5 not in rows


def test_mapping(spark):
    arg = "named_struct('type', '{}', 'value', '{}', 'parts', CAST(NULL AS array<string>))"
    make = lambda name, *args: f"SELECT '{name}' AS syscall_name, array({', '.join(arg.format(*a) for a in args)}) AS args, 0 AS retval"
    df = spark.sql(" UNION ALL ".join([make("setresuid", ("uint", 4294967295), ("uint", 0), ("uint", 5)), make("openat2", ("int", -100), ("resource", "/x"), ("ulong", 577), ("source", "sh")), make("cap_capable", ("int", 21)), make("setns", ("int", 3), ("int", 0x40000000)), make("dns_answer", ("str", "a.b"), ("uint", 1), ("uint", 0x0100007F), ("ulong", 9)), make("fchown", ("int", 4))]))
    got = {r.syscall_name: r for r in mapping.map_frames(df).collect()}
    named = {k: {a.name: a.value for a in r.named} for k, r in got.items()}
    assert named["setresuid"] == {"ruid": "unchanged", "euid": "0", "suid": "5", "new_uid": "0"}
    assert (got["openat2"].operation, got["openat2"].resource, got["openat2"].comm) == ("open_write", "/x", "sh")
    assert got["cap_capable"].resource == "CAP_SYS_ADMIN" and named["setns"] == {"flags": str(0x40000000), "ns_flags": "CLONE_NEWNET"}
    assert named["dns_answer"] == {"rtype": "1", "cgroup_id": "9", "addr": "127.0.0.1"} and named["fchown"] == {"fd": "4"}


def test_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    make = lambda a, b: spark.createDataFrame([(k, "intent", k * 10, "c", f"b{k}") for k in range(a, b)], "arrival long, stream string, ts_ns long, container_id string, body string").repartition(3)
    log.append(make(0, 50), path, 0)
    log.append(make(50, 80), path, 50)
    rows = log.read(spark, path)
    assert [(r.seq, r.body) for r in rows.orderBy("seq").collect()] == [(k + 1, f"b{k}") for k in range(80)]
    assert log.read_from(rows, 70, "intent").count() == 10 and log.read_from(rows, 0, "raw").count() == 0
    with pytest.raises(log.CursorExpired):
        log.read_from(rows.where("seq > 40"), 5, "intent")
    assert subscribe.resume(rows.where("seq > 40"), 5).count() == 0 and subscribe.resume(rows.where("seq > 40"), 5, "reset_to_snapshot").count() == 40
    with pytest.raises(ValueError):
        subscribe.resume(rows.where("seq > 40"), 5, "fail")
    sinks.write_sharded(rows.select(F.col("body").alias("intent_id")), f"{path}-shards")
    shards = spark.read.json(f"{path}-shards")
    assert shards.count() == 80 and all(int(hashes.fnv32([r.intent_id.encode()])[0]) % 4 == r.shard for r in shards.collect())


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_log_keeps_every_row(spark, tmp_path, adaptive):
    """Many rows over many partitions, with ties: numbers 1 to n, each once, in arrival order, in segments of bounded size."""
    path, n = f"{tmp_path}/log", 200_000
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        for first in (0, n):
            batch = spark.range(first, first + n, 1, 13).selectExpr("(id * 7919) % 100003 AS arrival", "'intent' AS stream", "id AS ts_ns", "'c' AS container_id", "string(id) AS body")
            log.append(batch, f"file://{path}", first, segment_bytes=1 << 18)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    rows = log.read(spark, f"file://{path}")
    assert rows.agg(F.count("*"), F.countDistinct("seq"), F.min("seq"), F.max("seq"), F.countDistinct("body")).first()[:] == (2 * n, 2 * n, 1, 2 * n, 2 * n)
    back = rows.selectExpr("seq", "bigint(body) * 7919 % 100003 AS arrival").where(f"seq <= {n}")
    assert back.selectExpr("arrival - lag(arrival) OVER (ORDER BY seq) AS d").where("d < 0").count() == 0
    sizes = [f.stat().st_size for f in (tmp_path / "log").glob("*.json")]
    assert max(sizes) < 2 * (1 << 18) and len(sizes) > 40


def test_shards_rotate_by_size(spark, tmp_path):
    rows = spark.range(4000).selectExpr("concat('i', id) AS intent_id", "repeat('x', 200) AS body")
    sinks.write_sharded(rows, f"file://{tmp_path}/s", file_bytes=50_000)
    files = list((tmp_path / "s").rglob("*.json"))
    assert max(f.stat().st_size for f in files) < 75_000 and len(files) >= 16 and spark.read.json(f"file://{tmp_path}/s").count() == 4000


def test_lineage_has_no_limit(spark):
    chain = [(k, f"e{k}", "FORK", f"n{k}", f"n{k + 1}", k, "") for k in range(200)]
    ring = [(300 + k, f"r{k}", "FORK", f"c{k}", f"c{(k + 1) % 5}", k, "") for k in range(5)] + [(310, "t", "EXEC", "c2", "tail", 1, ""), (311, "own", "FORK", "me", "me", 1, "")]
    edges = spark.createDataFrame(chain + ring, "seq long, edge_id string, kind string, src string, dst string, ts_ns long, session_id string")
    starts = spark.createDataFrame([("n200",), ("n3",), ("c0",), ("tail",), ("me",), ("none",)], "start string")
    got = {}
    for r in graph.lineage(edges, starts).orderBy("depth").collect():
        got.setdefault(r.start, []).append(r.node)
        assert len(got[r.start]) == r.depth
    assert got == {"n200": [f"n{k}" for k in range(199, -1, -1)], "n3": ["n2", "n1", "n0"], "c0": ["c4", "c3", "c2", "c1"], "tail": ["c2", "c1", "c0", "c4", "c3"]}


def test_globs_are_looked_up(spark):
    rng = random.Random(4)
    words = ["a", "b", "ab", "/", ".", "x"]
    subjects = sorted({"/" + "".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(300)} | {"web.example.org", "example.org", "a.b.example.org"})
    patterns = sorted({"/" + "".join(rng.choices([*words, "*", "?"], k=rng.randint(1, 6))) for _ in range(60)} | {"*.example.org", "*", "?x", "/*/x"})
    found = contract.glob_pairs(spark.createDataFrame([("f", s) for s in subjects], "category string, subject string"), spark.createDataFrame([("f", g) for g in patterns] + [("g", "/a*")], "category string, glob string"), ["category"])
    want = {(s, g) for s in subjects for g in patterns if re.fullmatch("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in g), s)}
    got = [(r.subject, r["glob"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_new_items_learn_from_all(spark):
    learnt = spark.createDataFrame([(k, f"/bin/{k}") for k in range(40)], "seq long, item string")
    scored = spark.createDataFrame([(100 + k, f"/bin/{k}") for k in range(30, 45)] + [(99, "/bin/44"), (200, "/bin/44")], "seq long, item string")
    got = sorted((r.seq, r.evidence) for r in baseline.new_items(scored, learnt, "item", "new_exec", "binary").collect())
    assert got == [(99, "binary=/bin/44"), (140, "binary=/bin/40"), (141, "binary=/bin/41"), (142, "binary=/bin/42"), (143, "binary=/bin/43")]


def test_contributing_ids_are_the_newest(spark):
    rows = [(k, k, 1, 3, "open" if k == 0 else "read", "/f", "openr", 1) for k in range(700)] + [(1000, 1000, 1, 3, "close", None, None, 0)]
    events = spark.createDataFrame(rows, "seq long, ts_ns long, pid long, fd int, op string, path string, hint string, bytes long")
    (r,) = intents.file_sessions(events, 10**9).collect()
    assert r.ids == [*range(445, 700), 1000] and r.n_events == 701 and r.bytes_read == 699


def test_long_strings_hash(spark):
    text = ["", "a", "foobar", "x" * 100_000, "é", *("k" * n for n in range(50))]
    def plain(b):
        h = 2166136261
        for c in b:
            h = (h ^ c) * 16777619 % 2**32
        return h
    assert hashes.fnv32([t.encode() for t in text]).tolist() == [plain(t.encode()) for t in text]


def test_interning(spark):
    """Ids from 1 by first sight; a full channel spends a number and tries again, a clash and an empty string have none, idle strings are forgotten."""
    rows = [(1, 0, "a", False, 1), (2, 1, "b", True, 2), (3, 2, "b", False, 2), (4, 3, "clash", False, 1), (5, 4, "", False, 0), (6, 5, "a", True, 1), (7, 5 + 600, "a", False, 1), (8, 700, "b", False, 2), (9, 701, "c", True, 3)]
    sights = spark.createDataFrame([(q, t * S, x, b, h) for q, t, x, b, h in rows], "seq long, ts_ns long, text string, backlogged boolean, hash long")
    got = {r.seq: (r.id, r.fresh) for r in interning.intern(sights).collect()}
    assert got == {1: (1, True), 2: (0, False), 3: (3, True), 4: (0, False), 5: (0, False), 6: (1, False), 7: (4, True), 8: (5, True), 9: (0, False)}
    assert sorted((r.seq, r.id) for r in interning.intern(sights.drop("hash").where("seq < 5")).collect()) == [(1, 1), (2, 0), (3, 3), (4, 4)]


def test_resolved_paths(spark):
    rows = [("", -100, None, None, "/"), ("a\0b", 5, "/d", False, "/"), ("", 5, "/d/f", False, None), ("", 5, "socket:[9]", True, None), ("", 5, None, None, None), ("/a/../b", 5, None, None, None), ("x", -100, None, None, None), ("x/./y", -100, None, None, "/home"), ("x", 5, "/d", True, "/"), ("../x", 5, "/d/e", False, "/"), ("/" + "q" * 50, 5, None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, raw string, dirfd int, fd string, sock boolean, cwd string")
    got = [r.x for r in df.select("n", scalars.resolved_path(F.col("raw"), F.col("dirfd"), F.col("fd"), F.col("sock"), F.col("cwd"), 40).alias("x")).orderBy("n").collect()]
    assert [g.reason for g in got] == ["empty_input", "path_contains_null", "", "", "fd_table_miss", "", "proc_lookup_failed", "", "fd_table_miss", "", "path_too_long"]
    assert [got[k].path for k in (2, 3, 5, 7, 9)] == ["/d/f", "socket:[9]", "/b", "/home/x/y", "/d/x"] and got[1].hint == "a\0b" and got[10].hint == "..." + "q" * 29


def test_documents_round_trip(spark):
    headers = spark.createDataFrame([("p1", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", 10, 0.5, 0.01, 0.02), ("p2", "", "", 0, 0.0, 0.0, 0.0)], "profile_id string, learn_start string, learn_end string, samples long, confidence double, rarity_floor double, markov_floor double")
    items = spark.createDataFrame([("p1", "exec", "/b"), ("p1", "exec", "/a"), ("p1", "exec", "/a"), ("p1", "uid", "10"), ("p1", "uid", "9"), ("p1", "file.write", "/w")], "profile_id string, category string, item string")
    made = documents.profile_documents(headers, items)
    body = {r.profile_id: json.loads(r.body) for r in made.collect()}
    assert body["p1"]["execBinaries"] == ["/a", "/b"] and body["p1"]["uids"] == [9, 10] and body["p1"]["schemaVersion"] == 3 and "filePaths" not in body["p1"] and "uids" not in body["p2"]
    found, own = documents.read_profiles(made)
    assert sorted(map(tuple, own.collect())) == sorted(set(map(tuple, items.collect()))) and sorted(tuple(r)[0::4] for r in found.collect()) == [("p1", 10), ("p2", 0)]
    rules_ = rules(spark, ("exec", {"binary": "/b"}), ("exec", {"binary": "/a"}), ("file.read", {"path": "/x"}), ("file.write", {"path_glob": "/y*"}), ("network.egress", {"peer": "1:1"}), ("network.egress", {"fqdn": "*.x.org"}), ("capability", {"name": "CAP_A"}), ("syscalls", {"name": "open"}))
    text = documents.contract_document(rules_, "c1")
    assert sorted(map(tuple, contract.parse(spark, text).collect())) == sorted(map(tuple, rules_.collect())) and [e["binary"] for e in json.loads(text)["spec"]["process"]["exec"]] == ["/a", "/b"]


def test_capability_report(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    hooks = capability.discover(names("open", "open", "read"), names("filp_close", "cap_capable"), ["bpf"])
    state = {r.probe: (r.state, r.warning) for r in capability.diagnose(hooks).collect()}
    assert state["syscall_tracepoint/open"] == ("ok", "") and state["lsm_bpf/file_open"] == ("ok", "") and state["kprobe/filp_close"] == ("ok", "")
    assert state["kprobe/security_path_link"] == ("missing", "kprobe/security_path_link: not in kallsyms/available_filter_functions") and len(state) == 2 + 6 + 17
    dark = {r.name: r for r in capability.discover(names("x"), names("y"), None).where("kind = 'lsm_bpf'").collect()}
    assert dark["bprm_check_security"].fallback == "kprobe:security_bprm_check" and dark["file_open"].reason == "LSM list not readable"


def test_findings_come_in_order(spark):
    seen = rules(spark, ("syscalls", {"name": "z"}), ("exec", {"binary": "/b"}), ("exec", {"binary": "/a"}), ("file.read", {"path": "/x"}))
    found = contract.findings_in_order(contract.gap(seen, rules(spark, ("capability", {"name": "C"}), ("exec", {"binary": "/c"})))).collect()
    assert [(r.category, r.subject) for r in found] == [("exec", "/a"), ("exec", "/b"), ("file.read", "/x"), ("syscalls", "z"), ("capability", "C"), ("exec", "/c")]


def test_fan_out_and_totals(spark, tmp_path):
    rows = spark.range(30).selectExpr("concat('i', id) AS intent_id")
    sinks.fan_out(lambda df, epoch: sinks.write_lines(df, f"file://{tmp_path}/a"), lambda df, epoch: sinks.write_sharded(df, f"file://{tmp_path}/b"))(rows, 0)
    assert spark.read.json(f"file://{tmp_path}/a").count() == spark.read.json(f"file://{tmp_path}/b").count() == 30
    one = spark.createDataFrame([(5, 4, 3, 2)], "frames_dropped long, intents long, syscalls long, frames_read long")
    assert [tuple(r) for r in control.totals(one).collect()] == [("syscalls", 3), ("intents", 4), ("frames_read", 2), ("frames_dropped", 5)] and control.totals(one, 2).count() == 2


def test_docker_listing(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"Id": "c1", "Names": ["/web"], "Image": "nginx", "Labels": {"a": "b"}}, {"Id": "c2"}]))
    assert sorted((r.container_id, r.container, r.image, r.labels) for r in dimensions.docker_listing(spark, f"file://{tmp_path}/d.json").collect()) == [("c1", "web", "nginx", {"a": "b"}), ("c2", "", None, None)]


def test_policies():
    assert policy.preset("network-only").level == "minimal" and policy.preset("none such") is None
    doc = {"kind": "HookSubscription", "metadata": {"name": "x"}, "spec": {"syscalls": {"include": ["a", "b"], "exclude": ["b"]}}}
    sub = policy.parse(doc)
    assert (sub.syscalls, sub.pairing, sub.on_missing, sub.history_depth, sub.history_secs) == (["a"], "enter_exit", "fail", 32, 30)
    assert policy.validate("HookSubscription", doc) == "" and "pairing" in policy.validate("HookSubscription", {**doc, "spec": {"pairing": "odd"}}) and policy.validate("Other", {}) == ""
    conf = policy.Config(level="full")
    assert conf.set(level="none", other="x") == {"level": "applied", "other": "unknown key"} and conf.values["level"] == "none"
    assert policy.thresholds("0.6,0.8,0.95") == (0.6, 0.8, 0.95)
    with pytest.raises(ValueError):
        policy.thresholds("0.8,0.6")


def test_enrichment_and_history(spark):
    opens = spark.createDataFrame([(1, 1, 1, 5, -100, "/base"), (2, 2, 1, 6, 5, "sub"), (3, 3, 1, 7, 6, "leaf"), (4, 4, 1, 8, 99, "lost")], "seq long, ts_ns long, pid long, fd int, dirfd int, path string")
    assert {r.seq: r.full for r in enrich.dirfd_paths(opens).collect()} == {1: "/base", 2: "/base/sub", 3: "/base/sub/leaf", 4: None}
    rows = spark.createDataFrame([(k, k * S, "a") for k in range(10)], "seq long, ts_ns long, key string")
    assert sorted(r.seq for r in history.ring(rows, "key", 4, 9 * S, 2 * S).collect()) == [7, 8, 9] and history.ring(rows, "key", 0).count() == 10
    assert np.array_equal([r.seq for r in history.bootstrap(rows, "key", 3 * S).orderBy("seq").collect()], [0, 1, 2, 3])


def test_dirfd_paths_have_no_depth_limit(spark):
    rows = [(1, 1, 1, 1, -100, "/top")] + [(k, k, 1, k, k - 1, f"d{k}") for k in range(2, 24)] + [(100 + k, 100 + k, 2, k, k - 1, f"e{k}") for k in range(2, 9)] + [(200, 200, 1, 90, 23, None)]
    opens = spark.createDataFrame(rows, "seq long, ts_ns long, pid long, fd int, dirfd int, path string")
    full = {r.seq: r.full for r in enrich.dirfd_paths(opens).collect()}
    assert len(full) == len(rows) and full[200] == full[23]
    assert all(full[k] == "/".join(["/top", *(f"d{j}" for j in range(2, k + 1))]) for k in range(1, 24))
    assert all(full[100 + k] is None for k in range(2, 9))
