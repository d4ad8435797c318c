"""Streams against the batch forms on the same rows."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators import control, intents
from tidewell.sources.events import syscalls
from tidewell.streaming import sessions, streams

HOUR = intents.HOUR_NS
COLUMNS = ["seq", "ts_ns", "pid", "fd", "op", "path", "hint", "bytes"]


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The canonical rows as two files in time order, and one far later row whose time ends all sessions."""
    path = str(tmp_path_factory.mktemp("rows"))
    rows = syscalls(spark, sf_dir).select(COLUMNS)
    half = rows.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seq)")).first()[0]
    rows.where(F.col("seq") <= half).coalesce(1).write.mode("append").parquet(path)
    rows.where(F.col("seq") > half).coalesce(1).write.mode("append").parquet(path)
    late = rows.agg(F.max("ts_ns")).first()[0] + 1000 * HOUR
    for k in range(2):
        spark.createDataFrame([(10**9 + k, late + k, -1, 0, "noop", None, None, 0)], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return path, rows


def test_sessions_are_those_of_the_batch(spark, parts):
    path, rows = parts
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(sessions.file_sessions(source, 48 * HOUR), "stream_sessions")
    names = [c.split()[0] for c in sessions.SESSION.split(", ")]
    want = intents.file_sessions(rows, 48 * HOUR).select(names)
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.collect()))


def test_coalescing_is_that_of_the_batch(spark, parts):
    path, rows = parts
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path).where("pid >= 0")
    got = drain(sessions.coalesced(source, 6 * HOUR), "stream_coalesced")
    want = control.coalesce_events(rows, ["pid"], 6 * HOUR)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_tail_join_and_cursor(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    spark.createDataFrame([(k, "a" if k % 2 else "b", f"2024-01-01 00:00:{k:02d}") for k in range(20)], "seq long, kind string, at string").coalesce(1).write.json(path)
    schema = "seq long, kind string, at timestamp"
    old, tail = streams.replay_then_tail(spark, path, schema, 10)
    assert old.count() == 9 and drain(tail, "tailed").count() == 9
    found = drain(streams.report_once(streams.tail(spark, path, schema).withColumn("evidence", F.lit("x")).select("kind", "evidence")), "once")
    assert sorted(r.kind for r in found.collect()) == ["a", "b"]
    left, right = (streams.tail(spark, path, schema, lambda df, k=k: df.where(F.col("kind") == k).withColumn("key", F.lit(1))) for k in ("a", "b"))
    pairs = drain(streams.interval_join(left, right, "key", "3 seconds"), "pairs")
    assert {(r.seq, r.ref_seq) for r in pairs.collect()} == {(a, b) for a in range(1, 20, 2) for b in range(0, 20, 2) if 0 <= a - b <= 3}
    assert {r.seq: r.ref_seq for r in streams.latest_only(pairs).collect()} == {a: a - 1 for a in range(1, 20, 2)}
    streams.commit_cursor(f"{path}-cursors", "me")(spark.read.schema(schema).json(path), 0)
    assert streams.cursor_of(spark, f"{path}-cursors", "me") == 19 and streams.cursor_of(spark, f"{path}-cursors", "you") == 0
