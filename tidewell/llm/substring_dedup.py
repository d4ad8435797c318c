"""Substring dedup: windows of words that occur twice or more, found by FM-indexes of shards.

1. Every text is cut into runs of consecutive windows with the same anchor, the
   least of the hashes of the `GRAM`-word strings in a window.  Equal windows
   have equal anchors, so a window can only recur where its anchor does.
2. Runs whose anchor occurs once in all texts are done.  The words of the others
   go, as segments that hold just the run's windows, to the shard of the anchor;
   an anchor of more than `crowd` texts hands out its windows one by one, each
   by its own hash, so that no shard grows with a frequent passage.  Equal
   segments meet in the shuffle and count as copies.
3. Each shard builds a compressed FM-index of its segments and streams them
   through backward search; windows with two occurrences are reported.

Words are known by 64-bit hashes, a sum of mixed (byte, place) pairs that no
regular pattern of bytes cancels.  Equal texts are handled once: with two
copies of a text, all its windows recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_caches, stored, text_of
from .fm_index import repeated_windows

WINDOW = 35
GRAM = 8
CROWD = 256
#: Texts hashed together: bounds the arrays of a task.
_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xA0761D6478BD642F)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int, known: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  kept between calls
    if base not in known or len(known[base][0]) < n or len(known[base][0]) > 4 * max(n, _BYTES):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        made = []
        for b in (base, inverse):
            out = np.ones(max(n, 1 << 16), dtype=np.uint64)
            out[1:] = b
            made.append(np.cumprod(out))
        known[base] = tuple(made)
    return known[base][0][:n], known[base][1][:n]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of values[start:end]: differences of one running sum."""
    up, down = _powers(base, len(values) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:-1])])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _word_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each joined[start:end]: every byte is mixed with its place in the word before the sum."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    begin = np.zeros(len(joined), dtype=np.int64)
    begin[starts] = np.diff(starts, prepend=0)
    place = (np.arange(len(joined)) - np.cumsum(begin)).astype(np.uint64)
    mixed = _mix((place << np.uint64(8) | joined.astype(np.uint64)) * _R + _SALT)
    edges = np.stack([starts, ends], axis=1).reshape(-1)  # a gap follows every word, so ends are places too
    return _mix(np.add.reduceat(mixed, edges)[::2] + (ends - starts).astype(np.uint64))


class Words:
    """The words of several texts: hashes, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        gap = (joined == 32) | ((joined >= 9) & (joined <= 13))
        edge = np.diff(gap.astype(np.int8), prepend=1)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.size = ends - starts
        self.hash = _word_hashes(joined, starts, ends)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(starts, begin)

    def windows(self, size: int) -> np.ndarray:
        """Hashes of the `size` words from each place on."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        at = np.arange(n)
        return _spans(self.hash, at, at + size, _Q)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > _BYTES:
            yield first, k
            first, total = k, 0
        total += n
    if sizes:
        yield first, len(sizes)


def _anchors(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            all_texts = batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in _grouped([len(t) for t in all_texts]):
                texts = all_texts[a:b]
                words = Words(texts)
                grams = words.windows(gram)
                n = np.diff(words.first)
                per = np.maximum(n - size + 1, 0)
                skipped = np.cumsum(per) - per
                place = np.arange(int(per.sum())) - np.repeat(skipped, per)  # of each window in its text
                flat = place + np.repeat(words.first[:-1], per)
                own = _least(grams, size - gram + 1)[flat] if len(flat) else np.zeros(0, dtype=np.uint64)
                fresh = np.flatnonzero((place == 0) | (np.diff(own, prepend=np.uint64(0)) != 0))
                runs = np.diff(fresh, append=len(own))
                # An anchor that stands twice in the words of one run counts twice.
                span = runs + size - gram
                inside = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span) + np.repeat(flat[fresh], span)
                same = grams[inside] == np.repeat(own[fresh], span)
                times = np.minimum(np.add.reduceat(same, np.cumsum(span) - span, dtype=np.int32), 2) if len(fresh) else np.zeros(0, dtype=np.int32)
                offsets = pa.array(np.searchsorted(fresh, np.append(skipped, len(own))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (own[fresh].view(np.int64), place[fresh].astype(np.int32), runs.astype(np.int32), times.astype(np.int32))]
                sha = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(sha, pa.string()), *lists],
                    names=["doc_id", "uid", "n_words", "sha", "anchors", "starts", "runs", "times"],
                )

    return run


def _segments(size: int):
    """(uid, start, key, seg) for each run, or for each window of a crowded run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            all_texts = batch.column(1).cast(pa.binary()).to_pylist()
            all_runs = batch.column(2).to_pylist()
            for a, b in _grouped([len(t) for t in all_texts]):
                words = Words(all_texts[a:b])
                hashes = words.windows(size).view(np.int64)
                uids = batch.column(0).slice(a, b - a).to_pylist()
                out: tuple[list, list, list, list] = ([], [], [], [])
                for k, uid in enumerate(uids):
                    i = int(words.first[k])
                    for r in all_runs[a + k]:
                        first = i + r["start"]
                        if r["crowded"]:
                            for x in range(first, first + r["run"]):
                                for c, v in zip(out, (uid, x - i, int(hashes[x]), words.hash[x : x + size].tobytes())):
                                    c.append(v)
                        else:
                            for c, v in zip(out, (uid, r["start"], r["anchor"], words.hash[first : first + r["run"] + size - 1].tobytes())):
                                c.append(v)
                        if len(out[0]) >= 4096:
                            yield _segment_batch(out)
                            out = ([], [], [], [])
                if out[0]:
                    yield _segment_batch(out)

    return run


def _segment_batch(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["uid", "start", "key", "seg"])


#: Words of one index: a shard's segments come sorted by key and are cut between keys.
_INDEX_WORDS = 400_000


def _searched(size: int):
    """(key, seg_id, flags) for the segments with a repeated window; flags has a byte for each window."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows([np.frombuffer(r[2], dtype=np.uint64) for r in rows], np.array([r[3] for r in rows]), size)
        found = [(r[0], r[1], f.astype(np.uint8).tobytes()) for r, f in zip(rows, flags) if f.any()]
        key, seg_id, bits = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(seg_id, pa.int64()), pa.array(bits, pa.binary())], names=["key", "seg_id", "flags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        held: list[tuple] = []
        words = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                for row in zip(*(batch.column(c).slice(k, 1024).to_pylist() for c in range(4))):
                    if words >= _INDEX_WORDS and row[0] != held[-1][0]:
                        yield search(held)
                        held, words = [], 0
                    held.append(row)
                    words += len(row[2]) // 8
        if held:
            yield search(held)

    return run


def _kept(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                uids, texts, found = (batch.column(c).slice(k, 256).to_pylist() for c in range(3))
                rows = []
                for uid, text, parts in zip(uids, texts, found):
                    words = text.encode().split()
                    gone = np.zeros(len(words) + 1, dtype=np.int32)
                    for p in parts:
                        at = np.flatnonzero(np.frombuffer(p["flags"], dtype=np.uint8)) + p["start"]
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + size, -1)
                    keep = np.cumsum(gone)[:-1] == 0
                    kept = b" ".join([w for w, ok in zip(words, keep) if ok])
                    rows.append((uid, len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if with_text else ()))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["uid", "n_removed", "kept_sha256", "kept_text"][: 3 + with_text])

    return run


def remove_repeated(docs: DataFrame, size: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256 (and kept_text, null where nothing was removed).

    Removed is each word in a window of `size` words whose sequence starts
    anywhere else too, same text included.  Null, empty and blank texts have no
    words; texts under `size` words lose none; repeated rows are copies of each
    other.  Other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    uid = F.md5("text").alias("uid")
    runs = stored(
        rows.select("doc_id", uid, "text").mapInArrow(_anchors(size, gram), "doc_id long, uid string, n_words long, sha string, anchors array<long>, starts array<int>, runs array<int>, times array<int>"),
        "runs",
    )
    # Texts are handled once; what has copies is all removed and only serves to find others.
    texts = runs.groupBy("uid").agg(F.least(F.count("*"), F.lit(2)).alias("copies"), F.first("anchors").alias("anchors"), F.first("starts").alias("starts"), F.first("runs").alias("runs"), F.first("times").alias("times"))
    texts = stored(texts.where("size(anchors) > 0"), "texts")
    cut = texts.select("uid", "copies", F.explode(F.arrays_zip("anchors", "starts", "runs", "times")).alias("r")).select("uid", "copies", F.col("r.anchors").alias("anchor"), F.col("r.starts").alias("start"), F.col("r.runs").alias("run"), F.col("r.times").alias("times"))
    again = cut.groupBy("anchor").agg(F.sum(F.col("copies") * F.col("times")).alias("n"), F.count("*").alias("texts")).where("n > 1").select("anchor", (F.col("texts") > crowd).alias("crowded"))
    chosen = cut.join(again, "anchor").groupBy("uid").agg(F.first("copies").alias("copies"), F.collect_list(F.struct("anchor", "start", "run", "crowded")).alias("chosen"))  # a text's own runs
    once = rows.select(uid, "text").groupBy("uid").agg(F.first("text").alias("text"))
    candidates = stored(once.join(chosen, "uid"), "candidates")
    segments = stored(candidates.select("uid", "text", "chosen").mapInArrow(_segments(size), "uid string, start int, key long, seg binary").join(candidates.select("uid", "copies"), "uid").withColumn("seg_id", F.xxhash64("seg")), "segments")
    distinct = segments.groupBy("key", "seg_id").agg(F.first("seg").alias("seg"), F.sum("copies").alias("copies"))
    shards = distinct.repartition("key").sortWithinPartitions("key", "seg_id").select("key", "seg_id", "seg", "copies")
    found = shards.mapInArrow(_searched(size), "key long, seg_id long, flags binary")
    places = segments.select("uid", "start", "key", "seg_id", "copies").where("copies = 1").join(found, ["key", "seg_id"]).groupBy("uid").agg(F.collect_list(F.struct("start", "flags")).alias("found"))  # a text's own windows
    kept = candidates.select("uid", "text").join(places, "uid").select("uid", "text", "found").mapInArrow(_kept(size, with_text), "uid string, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    known = texts.where("copies > 1").select("uid", F.lit(None).cast("long").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), *[F.lit("").alias("kept_text")] * with_text)
    changed = kept.unionByName(known)
    out = runs.select("doc_id", "uid", "n_words", "sha").join(changed.withColumn("changed", F.lit(True)), "uid", "left")
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("changed"), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *["kept_text"] * with_text,
    )
