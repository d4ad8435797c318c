"""Quality classifier: a regularised quadratic discriminant over document statistics.

Every text becomes a vector of transformed statistics.  Each class has a mean
and a covariance, shrunk towards the pooled one and the identity; a score is the
logistic of the difference of the log densities, from Mahalanobis distances by
Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_caches, stored, text_of
from .substring_dedup import Words, _grouped

#: Shrinkage of a class covariance to the pooled one, and of that to the identity; standardised statistics are cut at so many deviations.
TO_POOLED = 0.3
TO_IDENTITY = 0.05
CUT = 8.0
STATISTICS = (
    "words", "word_bytes", "word_spread", "symbols", "bangs", "uppers", "digits", "stops", "bars", "distinct", "same_lines", "line_words", "commonest", "short", "repeated",
)

_CLASS = np.zeros(256, dtype=np.int8)
for _k, _chars in enumerate((b"#*$%&<>", b"!?", bytes(range(65, 91)), b"0123456789", b".,;:", b"|", bytes(range(97, 123))), 1):
    _CLASS[list(_chars)] = _k


def _counts(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner: how many distinct keys, and the count of the commonest."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])]))
    most = np.zeros(n)
    np.maximum.at(most, o[first], np.diff(first, append=len(o)))
    return np.bincount(o[first], minlength=n).astype(float), most


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of transformed statistics for each text; an empty text has that of no words."""
    n = len(texts)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(n), size)
    kind = _CLASS[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    chars = np.bincount(owner * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    words = Words(texts)
    per = np.diff(words.first)
    own = np.repeat(np.arange(n), per)
    length = words.size.astype(float)
    total = np.bincount(own, weights=length, minlength=n)
    w = np.maximum(per, 1)
    mean = total / w
    spread = np.sqrt(np.maximum(np.bincount(own, weights=length**2, minlength=n) / w - mean**2, 0))
    distinct, most = _counts(own, words.hash, n)
    short = np.bincount(own[length <= 3], minlength=n)
    grams = words.windows(3)
    inside = np.arange(len(grams)) + 3 <= words.first[1:][own[: len(grams)]] if len(grams) else np.zeros(0, dtype=bool)
    gram_kinds, _ = _counts(own[: len(grams)][inside], grams[inside], n)
    windows = np.maximum(per - 2, 0)
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in lines], dtype=float)
    same = n_lines - np.array([len(set(x)) for x in lines])
    letters = chars[:, 3] + chars[:, 7]
    share = lambda part, whole: np.log((part + 0.5) / (whole + 5.0))
    return np.column_stack([
        np.log1p(per), np.log1p(mean), np.log1p(spread), share(chars[:, 1], total), share(chars[:, 2], total), share(chars[:, 3], letters),
        share(chars[:, 4], total), share(chars[:, 5], total), share(chars[:, 6], total), distinct / w, share(same, n_lines),
        np.log1p(per / n_lines), share(most, per), short / w, share(windows - gram_kinds, windows),
    ])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_caches()
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for a, b in _grouped([len(t) for t in texts]):
            rows = statistics(texts[a:b])
            offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)))], names=["doc_id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS) + 1
    sums = np.zeros((2, d, d))
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
        y = np.asarray(batch.column(1))
        x = np.column_stack([np.ones(len(x)), x])
        for c in (0, 1):
            sums[c] += x[y == c].T @ x[y == c]
    k = np.arange(sums.size)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sums.reshape(-1))], names=["k", "v"])


class Discriminant:
    """Fitted from each class's sums of (1, x)(1, x)'; without rows of both classes every score is a half."""

    def __init__(self, sums: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY):
        n = sums[:, 0, 0]
        self.fitted = bool((n > 1).all())
        if not self.fitted:
            return
        both = sums.sum(axis=0)
        self.mean = both[0, 1:] / n.sum()
        self.scale = np.sqrt(np.maximum(np.diag(both)[1:] / n.sum() - self.mean**2, 1e-9))
        means = (sums[:, 0, 1:] / n[:, None] - self.mean) / self.scale
        second = sums[:, 1:, 1:] / n[:, None, None]
        raw = sums[:, 0, 1:] / n[:, None]
        cov = (second - raw[:, :, None] * raw[:, None, :]) / np.outer(self.scale, self.scale)
        pooled = np.tensordot(n / n.sum(), cov, axes=1)
        shrunk = (1 - to_identity) * ((1 - to_pooled) * cov + to_pooled * pooled) + to_identity * np.eye(len(self.mean))
        self.means, self.factors = means, np.linalg.cholesky(shrunk)
        self.whiten = np.linalg.inv(self.factors)
        self.constant = np.log(n / n.sum()) - np.log(np.diagonal(self.factors, axis1=1, axis2=2)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        z = np.clip((x - self.mean) / self.scale, -CUT, CUT)
        density = [c - 0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) for c, m, w in zip(self.constant, self.means, self.whiten)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def _scored(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], names=["doc_id", "held_out", "score"])

    return run


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """From all labelled rows that are not held out; only sums of products reach the driver."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    rows = measured.where("NOT held_out").join(known, "doc_id").select("x", F.col("quality").cast("int").alias("y"))
    d = len(STATISTICS) + 1
    sums = np.zeros(2 * d * d)
    for r in rows.mapInArrow(_moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # 2 d x d sums
        sums[r["k"]] = r["v"]
    return Discriminant(sums.reshape(2, d, d))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")


def _passed(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            scores = [model.score(statistics(texts[a:b])) for a, b in _grouped([len(t) for t in texts])]
            good = np.concatenate(scores) >= 0.5 if scores else np.zeros(0, dtype=bool)
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            yield own.filter(pa.array(good))

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier predicts to be good, unchanged."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    measured = rows.where(~held_out()).join(known, "doc_id", "left_semi").mapInArrow(_measured, "doc_id long, x array<double>")
    model = fit(stored(measured.select("doc_id", held_out(), "x"), "statistics"), labels)
    return docs.select("*", text_of().alias("_text_to_score")).mapInArrow(_passed(model), docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Null and empty texts are scored as texts without words; a null doc_id is not
    held out and has no label; repeated rows score alike.  Labels other than 0
    and 1 are left out.  Only the text is an input of a score.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    measured = stored(rows.mapInArrow(_measured, "doc_id long, x array<double>").select("doc_id", held_out(), "x"), "statistics")
    model = fit(measured, labels)
    scored = measured.select("doc_id", "held_out", "x").mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
