"""SimHash near-duplicate groups by one-wildcard segment variants.

Two 64-bit fingerprints that differ in at most two bits are cut into only two
32-bit segments, A and B: at least one segment differs by one bit at most.
Every fingerprint is indexed under the 32 variants of A with one bit masked,
and under B as it is.  A pair with at most one differing bit in A meets under
the masked variant of that bit; a pair with both bits in A has equal Bs.  So 33
keys cover every link, an equality join finds the candidates, and the join
condition verifies the whole distance and keeps one key a pair.

Keys shared by more than `hot_key` fingerprints are refined: the other segment
differs in at most two bits, so of its three blocks one is equal; the join also
asks for that block.  No candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_caches, stored, text_of

SEED = 42
SHINGLE = 3
HOT_KEY = 1000
MAX_ROUNDS = 60


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) word shingles of UTF-8 `text`; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    at = [0, *accumulate(len(w) + 1 for w in words)]
    if len(words) < size:
        at, size = [at[0], at[-1]], 1
    digest = xxhash.xxh64_intdigest
    return voted(np.array([digest(line[a : b - 1], SEED) for a, b in zip(at, at[size:])], dtype="<u8"))


def voted(hashes: np.ndarray) -> int:
    """The bits that are set in over half of `hashes`; 0 where there are none."""
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].astype("<u8", copy=False)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_caches()
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "content"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, content) for every row of `docs`; fp is the fingerprint's bits as a signed long, content a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("content", F.xxhash64("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long, content long")


def _variants(a: str, b: str) -> str:
    """SQL: the 33 keys of a fingerprint with the segments `a` and `b`."""
    return f"array_append(transform(sequence(0, 31), p -> shiftleft(bigint(p), 32) | ({a} & ~shiftleft(1L, p))), shiftleft(32L, 32) | {b})"


_A, _B = "shiftrightunsigned(fp, 32)", "(fp & 4294967295L)"


def links(prints: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Pairs (u, v), u < v, of the distinct values of `prints.fp` that differ in one or two bits."""
    keyed = (
        prints.select("fp")
        .distinct()
        .selectExpr("fp", f"{_A} AS a", f"{_B} AS b")
        .selectExpr("fp", "a", "b", f"explode({_variants('a', 'b')}) AS key")
    )
    crowded = keyed.groupBy("key").count().where(F.col("count") > hot_key).select("key", F.lit(True).alias("hot"))
    dealt = keyed.join(crowded, "key", "left").selectExpr(
        "key", "fp", "a", "b",
        """explode(CASE WHEN hot THEN transform(sequence(0, 2), j -> shiftleft(j, 11) | int(shiftrightunsigned(CASE WHEN key < shiftleft(32L, 32) THEN b ELSE a END, 11 * j) & 2047))
           ELSE array(-1) END) AS sub""",
    )
    # 33 rows come of one here, which the planner's estimate of sizes leaves out: without the hint it sends them all to the driver to broadcast them.
    pair = dealt.alias("x").join(dealt.alias("y").hint("merge"), F.expr(_PAIR))
    return pair.selectExpr("x.fp AS u", "y.fp AS v")


#: The whole distance, and that this key is the one that stands for the pair.
_PAIR = """
    x.key = y.key AND x.sub = y.sub AND x.fp < y.fp
    AND bit_count(x.fp ^ y.fp) <= 2
    AND CASE WHEN x.key < shiftleft(32L, 32)
             THEN bit_count(x.a ^ y.a) = 1 OR (x.a = y.a AND x.key < 4294967296L)
             ELSE bit_count(x.a ^ y.a) = 2 END
    AND CASE WHEN x.sub < 2048 THEN true
             ELSE (CASE WHEN x.key < shiftleft(32L, 32) THEN x.b ^ y.b ELSE x.a ^ y.a END) & 2047L <> 0
                  AND (x.sub < 4096 OR (CASE WHEN x.key < shiftleft(32L, 32) THEN x.b ^ y.b ELSE x.a ^ y.a END) & 4192256L <> 0) END
"""


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each one reaches, for all nodes of `edges` (u, v).

    Alternating large-star and small-star rounds; each round is written to the
    shared folder, and only a count and a checksum reach the driver.
    """
    edges = stored(edges.select("u", "v").distinct(), "cc")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        down = stored(down, "cc")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = stored(small, "cc")
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def _placed(prints: DataFrame, hot_key: int) -> DataFrame:
    """(fp, root, head) for each distinct fingerprint; head is its smallest (doc_id, content)."""
    least = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "content")).alias("head"), F.min("doc_id").alias("first_id"))
    roots = components(links(least, hot_key))
    return least.join(roots, least.fp == roots.node, "left").select("fp", "head", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """One row per row of `docs`: doc_id, fp, fingerprint (16 hex digits), component_id.

    Null or empty texts, and texts without words, have fingerprint zero and are
    linked like any other.  Repeated rows come back as often as they came in; a
    null doc_id never names a component that has another id.  Other columns of
    `docs` are not looked at.
    """
    prints = stored(fingerprints(docs), "fp")
    placed = _placed(prints, hot_key)
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = placed.join(named, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_firsts(docs: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """The rows of `docs` that stand for their group: one row with the group's smallest doc_id.

    Of rows with that doc_id in the group, the one whose text has the smallest
    hash stays, and of rows with the same text too, the first one as JSON.  Rows
    without a doc_id can't be named and stay as they are.
    """
    named = docs.where("doc_id IS NOT NULL")
    prints = stored(fingerprints(named), "fp")
    return _of_heads(docs, _placed(prints, hot_key).groupBy("root").agg(F.min("head").alias("head")))


def _of_heads(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of `docs` with the (doc_id, content) of one of `heads`, one for each, and those without a doc_id."""
    heads = heads.select(F.col("head.doc_id").alias("_id"), F.col("head.content").alias("_content"))
    own = docs.where("doc_id IS NOT NULL").select(F.struct(*docs.columns).alias("own"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_of()).alias("_content"))
    kept = own.join(heads, ["_id", "_content"], "left_semi").groupBy("_id", "_content").agg(F.min_by("own", F.to_json("own")).alias("own"))
    return kept.select("own.*").unionByName(docs.where("doc_id IS NULL"))


# --- similar texts ------------------------------------------------------------------
#
# The same variants, verified by the similarity of the shingles.  Texts whose
# fingerprints differ in two bits meet as above.  That is too strict for all that
# are similar by 0.8: these differ in about ten bits, and segments short enough to
# be equal then are shared by everything.  So there are more fingerprints, one for
# each class of a text's shingles (dealt out by hash, one or two each), and in
# their row the same is done with whole fingerprints as above with bits: it is cut
# into segments, and each is indexed by its variants with one fingerprint masked.
# Of two texts with a similarity of 0.8 over six classes in ten hold the same
# shingles, and seven segments in ten are equal but for one class.

SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Classes of a signature, and shingles in each on the average where a text has enough.
CLASSES = 24
CLASS_SHINGLES = 2
#: Fingerprints in a segment of the row.
SEGMENT = 3
#: Equal classes that make a candidate, of the classes that hold shingles: one in so many.
EQUAL = 6
#: Orders in which a key's sets choose the one they meet in: with one, a third text could stand between two similar ones under all keys.
ORDERS = 6


def shingle_set(text: bytes, size: int = SIMILAR_WORDS) -> np.ndarray:
    """The different hashes of the lower-cased (A-Z) word shingles; of the whole sequence where there are fewer words, none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    at = [0, *accumulate(len(w) + 1 for w in words)]
    if len(words) < size:
        at, size = [at[0], at[-1]], 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a : b - 1], SEED) for a, b in zip(at, at[size:])], dtype=np.uint64))


def size_class(n: int) -> int:
    """Texts whose numbers of shingles differ by a quarter at most are in the same or in neighbouring size classes."""
    return int(np.floor(np.log(max(n, 1)) / np.log(1 / SIMILARITY) + 1e-9))


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints (64 bits, as signed longs) of the first classes of shingles, 0 for those that are empty; dealt out as texts of that size class are."""
    n = (1 / SIMILARITY) ** size
    classes = 1 << int(np.ceil(np.log2(max(n / CLASS_SHINGLES, min(n, CLASSES), 1))))
    own = ((shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (classes - 1)
    out = np.zeros(CLASSES, dtype=np.int64)
    used = np.flatnonzero(own < CLASSES)
    used = used[np.argsort(own[used], kind="stable")]
    if len(used):
        owner = own[used]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        bits = np.unpackbits(shingles[used].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
        votes = np.add.reduceat(bits, first, axis=0) * 2 > np.diff(first, append=len(used))[:, None]
        found = np.packbits(votes, axis=1, bitorder="little").view("<i8").reshape(-1)
        out[owner[first]] = np.where(found == 0, 1, found)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_caches()
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for text in part.column(1).cast(pa.large_binary()).to_pylist():
                shingles = shingle_set(text)
                size = size_class(len(shingles))
                fp = voted(shingles)
                rows.append((xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63), len(shingles), size, fp - (fp >> 63 << 64), signature(shingles, size).tolist(), signature(shingles, size + 1).tolist()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], names=["doc_id", "content", "sid", "n", "size", "fp", "low", "high"])


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = (part.column(k).cast(pa.large_binary()).to_pylist() for k in (2, 3))
                known: dict[bytes, np.ndarray] = {}  # a text that many are compared with comes many times in a row
                good = []
                for x, y in zip(a, b):
                    if y not in known:
                        known = {y: shingle_set(y)}
                    s, t = shingle_set(x), known[y]
                    same = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(same >= similarity * (len(s) + len(t) - same))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _keys() -> str:
    """SQL: the keys under which a set is indexed: its fingerprint's variants, and those of its row's segments as texts of its size class and of the next are dealt out."""
    mask = lambda m: f"k - k % {SEGMENT} + (k + {m}) % {SEGMENT}"
    left = [f"r.classes[{mask(m)}]" for m in range(1, SEGMENT)]
    row = f"transform(sequence(0, {CLASSES - 1}), k -> CASE WHEN {' OR '.join(f'{x} <> 0' for x in left)} THEN xxhash64(r.size, k, {', '.join(left)}) END)"
    rows = f"transform(array(named_struct('size', size, 'classes', low), named_struct('size', size + 1, 'classes', high)), r -> {row})"
    bits = f"transform({_variants(_A, _B)}, v -> xxhash64(v))"
    return f"flatten(array_append({rows}, {bits}))"


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(sid, head, root) of each different set of shingles in `docs` (doc_id, text): its smallest (doc_id, content), and the group it is in.

    Texts with equal sets are one.  The sets that share a variant, of their
    fingerprint or of a segment of the row, meet in its smallest one; those that
    differ from it in two bits at most, or have enough classes in common with
    it, are verified by the whole similarity of their shingles.  So there are no
    more pairs than variants, and no group's pairs are all looked at: two texts
    are found similar if a variant they share has one of them, or a third text
    similar to both, as the one to meet in.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("content", F.xxhash64("text"))
    signed = stored(rows.mapInArrow(_signed, "doc_id long, content long, sid long, n int, size int, fp long, low array<long>, high array<long>"), "signed")
    sets = signed.groupBy("sid").agg(F.min(F.struct("doc_id", "content")).alias("head"), *(F.first(c).alias(c) for c in ("n", "size", "fp", "low", "high")))
    sets = stored(sets, "sets")
    seen = sets.where("n > 0").selectExpr("sid", f"posexplode({_keys()}) AS (k, key)").where("key IS NOT NULL").selectExpr("sid", "key", f"named_struct('place', xxhash64(k % {ORDERS}, sid), 'sid', sid) AS own")
    centres = seen.groupBy("key").agg(F.min("own").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", F.col("least.sid").alias("centre"))
    pairs = stored(seen.join(centres.hint("merge"), "key").where("sid <> centre").select("sid", "centre").distinct(), "pairs")
    a = sets.selectExpr("sid", "size AS a_size", "fp AS a_fp", "low AS a_low", "high AS a_high")
    b = sets.selectExpr("sid AS centre", "size AS b_size", "fp AS b_fp", "low AS b_low", "high AS b_high")
    same = lambda x, y: f"size(filter(zip_with({x}, {y}, (p, q) -> p = q AND p <> 0), e -> e)) * {EQUAL} >= greatest(size(filter({x}, p -> p <> 0)), size(filter({y}, p -> p <> 0)))"
    alike = f"bit_count(a_fp ^ b_fp) <= 2 OR CASE a_size - b_size WHEN 0 THEN {same('a_low', 'b_low')} WHEN 1 THEN {same('a_low', 'b_high')} WHEN -1 THEN {same('a_high', 'b_low')} ELSE false END"
    likely = stored(pairs.join(a, "sid").join(b, "centre").where(alike).select("sid", "centre"), "likely")
    wanted = likely.select("sid").union(likely.select("centre")).distinct().join(sets.select("sid", "head.*"), "sid")
    texts = stored(rows.join(wanted, ["doc_id", "content"]).groupBy("sid").agg(F.first("text").alias("text")), "texts")
    checked = likely.join(texts.withColumnRenamed("text", "a"), "sid").join(texts.selectExpr("sid AS centre", "text AS b"), "centre").select("sid", "centre", "a", "b")
    links = checked.mapInArrow(_verified(similarity), "u long, v long").selectExpr("least(u, v) AS u", "greatest(u, v) AS v")
    roots = components(links)
    return sets.join(roots, sets.sid == roots.node, "left").select("sid", "head", F.coalesce("root", "sid").alias("root"))


def keep_dissimilar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stand for their group of similar texts: one row with the group's smallest doc_id.

    Texts without words are one group.  Ties are as keep_firsts() has them; rows
    without a doc_id stay as they are.
    """
    named = docs.where("doc_id IS NOT NULL")
    heads = similar_groups(named, similarity).groupBy("root").agg(F.min("head").alias("head"))
    return _of_heads(docs, heads)
