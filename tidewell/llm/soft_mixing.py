"""Mixing to target weights by soft membership, in DataFrame operations only.

A classifier learnt from a labelled table gives each document a posterior over
domains.  Nonnegative document rates are then fitted by projected gradient so
that the expected token totals of the domains match their targets: with u the
documents' shares of all tokens, p their posteriors and b the target shares, the
residual is e = sum(u p r) - b, the loss e' G^-1 e + ridge * sum(u (r - 1)^2)
with G = sum(u p p'), and a step is

    r <- max(0, r - p' G^-1 e - ridge (r - 1))

A document's rate follows from its posterior and the steps so far, so a round is
one aggregate of a few sums; no rate is stored and nothing but sums is collected.
"""

from __future__ import annotations

import logging
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Domains of the labelled table and their target shares of the tokens.
TARGETS = {"good": 0.90, "poor": 0.06, "toxic": 0.04}
RIDGE = 1e-3
ROUNDS = 40
#: Rounds end when the domains' shares move by less than this, or are as close to their targets.
CLOSE = 1e-5
#: A residual share from which a target counts as missed, and is reported.
MISSED = 1e-3
#: Labelled rows that the word list is learnt from, and its length.
SAMPLE = 4000
TERMS = 24
FLOOR = 0.05
_X = ("x0", "x1", "x2", "x3", "x4")


def domain_of() -> Column:
    return F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END")


def telling_words(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> list[str]:
    """Words that mark toxic documents, from a sample of `sample` labelled rows: in 5% of those (5 at least), and eight times as common as elsewhere."""
    chosen = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    words = rows.select("toxic", F.explode(F.array_distinct(F.expr("regexp_extract_all(lower(text), r'\\p{L}{3,}', 0)"))).alias("word"))
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if not size.get(1) or not size.get(0):
        return []
    seen = words.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = ((F.col("a") + 0.5) / (size[1] + 1)) / ((F.col("b") + 0.5) / (size[0] + 1))
    found = seen.where((F.col("a") >= max(5, 0.05 * size[1])) & (odds >= 8)).orderBy(F.desc(odds), "word").limit(terms)
    return [r["word"] for r in found.select("word").collect()]


def _measures(words: list[str]) -> list[Column]:
    """Tokens and the classifier's inputs, from `text` and `low`, its lower-case form.

    The word list's pattern is only run on texts that hold one of the words at all.
    """
    first = "".join(sorted({w[0] for w in words}))
    any_ = " OR ".join(f"contains(low, '{w}')" for w in words)
    pattern = f"(?=[{first}])(?<!\\p{{L}})(?:{'|'.join(sorted(words))})(?!\\p{{L}})"
    hits = f"CASE WHEN {any_} THEN regexp_count(low, r'{pattern}') ELSE 0 END" if words else "0"
    return [
        F.expr(r"bigint(regexp_count(text, r'[^\x20\x09-\x0D]+'))").alias("tokens"),
        F.expr(hits).alias("hits"),
        F.expr("length(text)").alias("chars"),
        F.expr("regexp_count(text, r'[#*$%&|<>!]')").alias("marks"),
        F.expr("regexp_count(text, r'[A-Z]{2}')").alias("shouts"),
        F.expr("CASE WHEN contains(text, ' | ') THEN regexp_count(text, r' \\| ') ELSE 0 END").alias("bars"),
    ]


def _inputs() -> list[str]:
    return [
        "ln(1 + 100 * hits / (tokens + 1)) AS x0", "ln(1 + 100 * marks / (chars + 1)) AS x1", "ln(1 + 100 * shouts / (chars + 1)) AS x2",
        "ln(1 + 100 * bars / (tokens + 1)) AS x3", "ln(1 + tokens) / 4 AS x4",
    ]


def _posteriors(sums: list, domains: tuple[str, ...]) -> list[str]:
    """SQL of each domain's posterior: Gaussian naive Bayes, from counts, means and variances."""
    known = {r["domain"]: r for r in sums if r["n"] and r["domain"] in domains}
    total = sum(r["n"] for r in known.values())
    logs = {}
    for d, r in known.items():
        parts = [f"{float(np.log(r['n'] / total))!r}D"]
        for x in _X:
            var = float(r[f"v_{x}"] or 0) + FLOOR
            parts.append(f"- {0.5 * float(np.log(var))!r}D - {0.5 / var!r}D * power({x} - ({float(r[f'm_{x}'])!r}D), 2)")
        logs[d] = "(" + " ".join(parts) + ")"
    if not logs:
        return [f"{1 / len(domains)!r}D" for _ in domains]
    top = f"greatest({', '.join(logs.values())})" if len(logs) > 1 else next(iter(logs.values()))
    weight = {d: f"exp({x} - {top})" for d, x in logs.items()}
    return [f"{weight[d]} / ({' + '.join(weight.values())})" if d in weight else "0D" for d in domains]


def rate(domains: tuple[str, ...], steps: list[np.ndarray], ridge: float = RIDGE) -> Column:
    """A document's rate after these steps, from its posteriors."""
    if not steps:
        return F.lit(1.0)
    moves = ", ".join("named_struct(" + ", ".join(f"'s{k}', {float(v)!r}D" for k, v in enumerate(step)) + ")" for step in steps)
    move = " + ".join(f"s.s{k} * p_{d}" for k, d in enumerate(domains))
    return F.expr(f"aggregate(array({moves}), 1D, (r, s) -> greatest(0D, r - ({move}) - {ridge!r}D * (r - 1D)))")


class Fit(NamedTuple):
    """The gradient steps, by domain how far the expected share is from its target after them, and whether the shares stand still."""

    steps: list[np.ndarray]
    off: dict[str, float]
    settled: bool


def fit_rates(scored: DataFrame, targets: dict[str, float], ridge: float = RIDGE, rounds: int = ROUNDS, close: float = CLOSE) -> Fit:
    """Every target is fitted as it is.  A domain without any mass can't be met: its residual is its target, negative."""
    domains = tuple(targets)
    tokens = scored.agg(F.sum("tokens").alias("n")).first()["n"]
    if not tokens:
        return Fit([], {d: -share for d, share in targets.items()}, True)
    u = F.col("tokens") / F.lit(float(tokens))
    pairs = [F.sum(u * F.col(f"p_{a}") * F.col(f"p_{b}")) for a in domains for b in domains]
    sums = np.array(scored.agg(*pairs, *(F.sum(u * F.col(f"p_{d}")) for d in domains)).first(), dtype=float)
    k = len(domains)
    gram, natural = sums[: k * k].reshape(k, k), sums[k * k :]
    aim = np.array([targets[d] for d in domains])
    inverse = np.linalg.inv(gram + 1e-4 * np.eye(k))
    steps: list[np.ndarray] = []
    before, settled = natural, False
    for k in range(rounds + 1):
        r = rate(domains, steps, ridge)
        have = np.array(scored.agg(*(F.sum(u * F.col(f"p_{d}") * r) for d in domains)).first(), dtype=float)
        settled = bool(np.abs(have - aim).max() < close or (steps and np.abs(have - before).max() < close))
        if settled or k == rounds:
            break
        before = have
        steps.append(inverse @ (have - aim))
    return Fit(steps, dict(zip(domains, map(float, have - aim))), settled)


def _mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], carry: list[str], ridge: float) -> DataFrame:
    """(own, tokens, p_<domain>, rate, copies); `own` holds the columns of `carry`."""
    domains = tuple(targets)
    words = telling_words(docs, labels)
    own = docs.select(F.struct(*carry).alias("own"), F.col("doc_id").alias("id"), text_of().alias("text"))
    rows = own.withColumn("low", F.lower("text")).select("own", "id", F.xxhash64("id", "text").alias("draw"), *_measures(words)).selectExpr("own", "id", "draw", "tokens", *_inputs())
    rows = stored(rows, "measures")
    known = labels.select(F.col("doc_id").alias("id"), domain_of().alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL")
    sums = rows.join(known, "id").groupBy("domain").agg(F.count("*").alias("n"), *(F.avg(x).alias(f"m_{x}") for x in _X), *(F.var_pop(x).alias(f"v_{x}") for x in _X)).collect()  # a row a domain
    posterior = [f"{p} AS p_{d}" for d, p in zip(domains, _posteriors(sums, domains))]
    scored = rows.selectExpr("own", "draw", "tokens", *posterior)
    fit = fit_rates(stored(scored.drop("own", "draw"), "posteriors"), targets, ridge)
    log = logging.getLogger(__name__)
    if missed := {d: round(e, 4) for d, e in fit.off.items() if abs(e) >= MISSED}:
        log.warning("expected shares that miss their targets, by: %s", missed)
    if not fit.settled:
        log.warning("shares still moved after %d rounds", len(fit.steps))
    out = scored.withColumn("rate", rate(domains, fit.steps, ridge))
    told = [f"{e!r}D AS off_{d}" for d, e in fit.off.items()]
    return out.selectExpr("own", "tokens", *(f"p_{d}" for d in domains), "rate", "int(floor(rate + pmod(draw, 1048576) / 1048576D)) AS copies", *told, f"{len(fit.steps)} AS rounds", f"{str(fit.settled).lower()} AS settled")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, carry: list[str] | None = None, ridge: float = RIDGE) -> DataFrame:
    """One row per row of `docs`: its columns (or those of `carry`), tokens, p_<domain>, rate, copies, off_<domain>, rounds, settled.

    The last ones are those of the fit, alike in all rows: how far each domain's
    expected share of the tokens is from its target, the rounds, and whether the
    shares stood still at the end.  `copies` rounds the rate up or down by a hash of the row, so that its mean is
    the rate.  Null and empty texts have no tokens and their rate follows from
    their posterior alike; repeated rows are rated alike; without labels all
    posteriors are equal.  Columns of `docs` that are named like the result's own
    are left out.
    """
    targets = targets or TARGETS
    made = {"tokens", "rate", "copies", "rounds", "settled", *(f"{c}_{d}" for c in ("p", "off") for d in targets)}
    found = _mixed(docs, labels, targets, [c for c in carry or docs.columns if c not in made], ridge)
    return found.select("own.*", *(c for c in found.columns if c != "own"))


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, ridge: float = RIDGE) -> DataFrame:
    """The rows of `docs`, each as often as its rate says, with all their columns."""
    found = _mixed(docs, labels, targets or TARGETS, docs.columns, ridge)
    return found.where("copies > 0").select("own", F.explode(F.expr("array_repeat(0, copies)")).alias("copy")).select("own.*")
