"""Listings, cgroups, DNS packets, identifiers and lifecycles."""

import json
import struct
import time

from pyspark.sql import functions as F

from tidewell.functions import ids
from tidewell.operators import enrich
from tidewell.sources import dimensions


def test_listing(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"containers": [{"id": "c1", "podSandboxId": "p1", "metadata": {"name": "web"}, "image": {"image": "sha"}, "imageRef": "r", "labels": {"a": "own"}}, {"id": "c2", "podSandboxId": "gone", "image": {}, "imageRef": "r2"}]}))
    (tmp_path / "p.json").write_text(json.dumps({"items": [{"id": "p1", "metadata": {"name": "pod", "namespace": "ns", "uid": "u"}, "labels": {"a": "pod", "b": "pod"}}]}))
    found = {r.container_id: r for r in enrich.containers_with_pods(*dimensions.container_listing(spark, f"file://{tmp_path}/c.json", f"file://{tmp_path}/p.json")).collect()}
    assert found["c1"].labels == {"a": "own", "b": "pod"} and (found["c1"].image, found["c1"].namespace) == ("sha", "ns") and (found["c2"].image, found["c2"].pod) == ("r2", None)
    lines = spark.createDataFrame([(1, "0::/kubepods.slice/kubepods-podx_1.slice/crio-abc.scope"), (2, "0::/user.slice")], "cgroup_id long, line string")
    assert [tuple(r) for r in dimensions.cgroup_index(lines).collect()] == [(1, "abc", "x_1")]


def test_dns(spark):
    q = b"\x03www\x07example\x03com\x00" + struct.pack(">HH", 1, 1)
    rr = lambda kind, data: b"\xc0\x0c" + struct.pack(">HHIH", kind, 1, 60, len(data)) + data
    packet = struct.pack(">6H", 7, 0x8180, 1, 3, 0, 0) + q + rr(1, bytes([1, 2, 3, 4])) + rr(28, bytes(16)) + rr(1, bytes([5, 6, 7, 8]))
    rows = spark.createDataFrame([(1, 9, bytearray(packet)), (2, 9, bytearray(struct.pack(">6H", 7, 0x0100, 1, 0, 0, 0) + q)), (3, 9, bytearray(packet[:40])), (4, 9, None), (5, 9, bytearray(b"\xff" * 30))], "seq long, ts_ns long, raw binary")
    assert [tuple(r) for r in dimensions.dns_events(rows).collect()] == [(1, 9, "www.example.com", "1.2.3.4"), (1, 9, "www.example.com", "5.6.7.8")]


def test_uuid7(spark):
    before = time.time_ns() // 1_000_000
    made = ids.uuid7(5000)
    assert len(set(made)) == 5000 and made == sorted(made) and all(m[14] == "7" and m[19] in "89ab" for m in made) and int(made[0].replace("-", "")[:12], 16) >= before
    assert spark.range(100).select(ids.event_id(F.col("id")).alias("i")).distinct().count() == 100


def test_pump_and_lifecycle(spark):
    a = spark.createDataFrame([(1, None), (2, "short header")], "seq long, error string")
    good, bad = dimensions.pumped([a, a])
    assert good.count() == 2 and [tuple(r) for r in bad.collect()] == [("short header", 2)]
    life = spark.createDataFrame([(1, "w", "activate", "p1"), (2, "w", "activate", "p2"), (3, "x", "activate", "p3"), (4, "x", "deactivate", None), (5, "w", "promote", "p9")], "seq long, workload string, action string, profile_id string")
    assert [tuple(r) for r in dimensions.active_model(life).collect()] == [("w", "p2")]
    sessions = spark.createDataFrame([("s1",)], "session_id string")
    states = spark.createDataFrame([(1, "c", "start"), (2, "c", "stop")], "seq long, container_id string, kind string")
    assert sorted(tuple(r) for r in dimensions.snapshot(sessions, states).collect()) == [("container", "c", "stop"), ("session", "s1", "open")]
