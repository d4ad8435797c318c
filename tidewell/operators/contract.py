"""Behaviour contracts: rules out of profiles, decisions, replay and gap reports.

A contract is a rule table (category, path, path_glob, peer, fqdn, binary, name).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import is_glob, regex_of
from ..schema import RULE

CATEGORIES = ("exec", "file.read", "file.write", "network.egress", "capability", "syscalls")

#: What a finding says, by category.
DENIED = {
    "exec": "policy does not allow this exec target", "file.read": "policy does not allow reading this path", "file.write": "policy does not allow writing this path",
    "network.egress": "policy does not allow this egress peer", "capability": "policy does not allow this capability", "syscalls": "policy does not allow this syscall",
}
UNUSED = {
    "exec": "policy allows this exec but runtime never used it", "file.read": "policy allows read but no observation matched", "file.write": "policy allows write but no observation matched",
    "network.egress": "policy allows egress peer but runtime never connected", "capability": "policy allows capability but runtime never used it", "syscalls": "policy allows syscall but runtime never used it",
}


def subject() -> Column:
    """What a rule is about: its glob, else whichever column is set."""
    return F.coalesce(*(F.expr(f"nullif({c}, '')") for c in ("path_glob", "path", "peer", "binary", "name")), F.lit(""))


def rules_of(items: DataFrame, confidence: float, least: float) -> DataFrame:
    """Rules out of a promoted profile's items (category, item); writing covers reading."""
    if confidence < least:
        raise ValueError("profile confidence below the minimum")
    files = items.where("category = 'file'").join(items.where("category = 'file.write'").select("item", F.lit(True).alias("written")), "item", "left")
    file_rules = files.select(F.when(F.col("written"), "file.write").otherwise("file.read").alias("category"), F.when(is_glob(F.col("item")), "").otherwise(F.col("item")).alias("path"), F.when(is_glob(F.col("item")), F.col("item")).otherwise("").alias("path_glob"))
    empty = F.lit("")
    columns = [c.split()[0] for c in RULE.split(", ")]

    def part(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c) if c in df.columns else empty.alias(c) for c in columns))

    return (
        part(file_rules)
        .unionByName(part(items.where("category = 'exec'").select("category", F.col("item").alias("binary"))))
        .unionByName(part(items.where("category = 'peer'").select(F.lit("network.egress").alias("category"), F.col("item").alias("peer"))))
        .unionByName(part(items.where("category = 'syscall'").select(F.lit("syscalls").alias("category"), F.col("item").alias("name"))))
    )


def ordered(rules: DataFrame) -> DataFrame:
    return rules.orderBy("category", subject())


def parse(spark: SparkSession, raw: str, kind: str = "BehaviorContract") -> DataFrame:
    """A contract document, JSON where it starts with a bracket and YAML otherwise, as rules in order."""
    text = raw.lstrip()
    if text[:1] in "{[":
        doc = json.loads(text)
    else:
        import yaml

        doc = yaml.safe_load(text)
    if not isinstance(doc, dict) or doc.get("kind") != kind:
        raise ValueError(f"kind must be {kind}")
    if "/" not in str(doc.get("apiVersion", "")):
        raise ValueError("apiVersion must name a group and a version")
    spec, rows = doc.get("spec") or {}, []
    row = lambda category, **k: rows.append(tuple({"category": category, "path": "", "path_glob": "", "peer": "", "fqdn": "", "binary": "", "name": "", **k}.values()))
    for r in (spec.get("process") or {}).get("exec") or []:
        row("exec", binary=r.get("binary", ""))
    for way in ("read", "write"):
        for r in (spec.get("file") or {}).get(way) or []:
            row(f"file.{way}", path=r.get("path", ""), path_glob=r.get("pathGlob", ""))
    for r in (spec.get("network") or {}).get("egress") or []:
        row("network.egress", peer=r.get("peer", ""), fqdn=r.get("fqdn", ""))
    for c in spec.get("capabilities") or []:
        row("capability", name=c)
    for c in spec.get("syscalls") or []:
        row("syscalls", name=c)
    return ordered(spark.createDataFrame(rows, RULE))


def glob_pairs(wanted: DataFrame, globs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, subject, glob): which of the distinct subjects (keys, subject) each of the distinct globs (keys, glob) matches.

    Globs are looked up by their literal start, or where they have none by their
    literal end: an equality join on that text for each of the lengths there are
    (no more than a path has characters), and only what agrees is matched.
    """
    ends = globs.select(*keys, "glob", F.regexp_extract("glob", r"^[^*?]*", 0).alias("head"), F.regexp_extract("glob", r"[^*?]*$", 0).alias("tail"))
    ends = ends.select(*keys, "glob", F.expr("head = ''").alias("back"), F.expr("CASE WHEN head = '' THEN tail ELSE head END").alias("part"))
    lengths = ends.select("back", F.length("part").alias("n")).distinct().collect()  # lengths of paths, not rows
    of = lambda back: ", ".join(str(r["n"]) for r in lengths if r["back"] == back)
    parts = [f"transform(filter(array({of(back)}), n -> n <= length(subject)), n -> named_struct('back', {str(back).lower()}, 'part', {side}(subject, n)))" for back, side in ((False, "left"), (True, "right")) if of(back)]
    if not parts:
        return wanted.select(*keys, "subject", F.lit("").alias("glob")).limit(0)
    dealt = wanted.select(*keys, "subject", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("p")).select(*keys, "subject", "p.back", "p.part")
    return dealt.join(ends, [*keys, "back", "part"]).where(F.rlike("subject", regex_of(F.col("glob")))).select(*keys, "subject", "glob")


def allowed(rules: DataFrame, subjects: DataFrame) -> DataFrame:
    """The distinct `subjects` (category, subject) that a rule of their category allows: equal, or by glob."""
    exact = rules.select("category", F.explode(F.array("path", "peer", "binary", "name")).alias("subject")).where("subject <> ''").distinct()
    wanted = subjects.select("category", "subject").distinct()
    equal = wanted.join(exact, ["category", "subject"], "left_semi")
    globs = rules.where("path_glob <> ''").select("category", F.col("path_glob").alias("glob")).distinct()
    by_glob = glob_pairs(wanted.join(exact, ["category", "subject"], "left_anti"), globs, ["category"]).select("category", "subject").distinct()
    return equal.unionByName(by_glob)


def allowed_names(rules: DataFrame, names: DataFrame) -> DataFrame:
    """The distinct `names` (subject) that the egress rules' domain names allow: equal, or by glob."""
    fqdn = rules.where("category = 'network.egress' AND fqdn <> ''").select(F.col("fqdn").alias("glob")).distinct()
    wanted = names.select("subject").distinct()
    equal = wanted.join(fqdn.withColumnRenamed("glob", "subject"), "subject", "left_semi")
    return equal.unionByName(glob_pairs(wanted, fqdn.where(is_glob(F.col("glob"))), []).select("subject")).distinct()


def decide(rules: DataFrame, intents: DataFrame) -> DataFrame:
    """`intents` (kind, subject, ...) with allow and reason.

    Distinct subjects are matched with the rules once, so hot subjects cost no more than others.
    """
    need = intents.select("subject", F.explode(F.expr("""CASE WHEN kind IN ('ProcessStart', 'Exec') THEN array('exec') WHEN kind = 'FileRead' THEN array('file.read')
        WHEN kind = 'FileWrite' THEN array('file.write') WHEN kind IN ('FileAccess', 'FileReadWrite') THEN array('file.read', 'file.write')
        WHEN kind = 'NetworkExchange' THEN array('network.egress') END""")).alias("category")).where("subject <> ''")  # fmt: skip
    ok = allowed(rules, need)
    dns = allowed_names(rules, intents.where("kind = 'DNSAnswer' AND subject <> ''"))
    flags = ok.groupBy("subject").agg(*(F.max(F.when(F.col("category") == c, True)).alias(f"ok_{k}") for k, c in enumerate(("exec", "file.read", "file.write", "network.egress"))))
    rows = intents.join(flags, "subject", "left").join(dns.withColumn("ok_4", F.lit(True)), "subject", "left")
    yes = [F.coalesce(F.col(f"ok_{k}"), F.lit(False)) for k in range(5)]
    groups = [("exec", F.col("kind").isin("ProcessStart", "Exec"), yes[0], "binary"), ("file.read", F.col("kind") == "FileRead", yes[1], "path"), ("file.write", F.col("kind") == "FileWrite", yes[2], "path"), ("file.access", F.col("kind") == "FileAccess", yes[1] | yes[2], "path"), ("egress", F.col("kind") == "NetworkExchange", yes[3], "peer"), ("dns", F.col("kind") == "DNSAnswer", yes[4], "query")]
    allow, reason = F.lit(True), F.lit("out_of_scope")
    both = F.col("kind") == "FileReadWrite"
    missing = F.coalesce(F.col("subject"), F.lit("")) == ""
    denied = lambda name: F.concat(F.lit(f"{name} not in allow-set: "), F.col("subject"))
    reason = F.when(both & missing, "missing path attr").when(both & ~yes[1], denied("file.read")).when(both & ~yes[2], denied("file.write")).when(both, "file.read+write permitted").otherwise(reason)
    allow = F.when(both & ~missing, yes[1] & yes[2]).otherwise(allow)
    for name, of, good, attr in groups:
        reason = F.when(of & missing, f"missing {attr} attr").when(of & good, f"{name} permitted").when(of, denied(name)).otherwise(reason)
        allow = F.when(of & ~missing, good).otherwise(allow)
    return rows.select(*intents.columns, allow.alias("allow"), reason.alias("reason"))


def replay(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count("*").alias("total"), F.count_if("allow").alias("allowed"), F.count_if(~F.col("allow")).alias("denied"))


def denied_samples(decisions: DataFrame, n: int = 20) -> DataFrame:
    """The first `n` denials in arrival order: a top-k."""
    return decisions.where(~F.col("allow")).orderBy("seq").limit(n).select("seq", "kind", "reason")


def _keys(rules: DataFrame, categories: tuple[str, ...], keep_empty: bool) -> DataFrame:
    rows = rules.where(F.col("category").isin(*categories)).select("category", subject().alias("subject")).distinct()
    return rows if keep_empty else rows.where("subject <> ''")


def _reasons(table: dict[str, str]):
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("category"))


def gap(observed: DataFrame, policy: DataFrame, categories: tuple[str, ...] = CATEGORIES, keep_empty: bool = False) -> DataFrame:
    """Findings (kind, category, subject, reason): observed but denied, and allowed but unused; findings_in_order() sorts them."""
    seen, may = _keys(observed, categories, keep_empty), _keys(policy, categories, keep_empty)
    denied = seen.join(allowed(policy, seen), ["category", "subject"], "left_anti")
    used_exactly = may.join(allowed(observed, may), ["category", "subject"], "left_semi")
    globs = policy.where(F.col("category").isin(*categories) & (F.col("path_glob") != "")).select("category", F.col("path_glob").alias("glob")).distinct()
    by_glob = glob_pairs(seen, globs, ["category"]).select("category", F.col("glob").alias("subject")).distinct()
    unused = may.join(used_exactly, ["category", "subject"], "left_anti").join(by_glob, ["category", "subject"], "left_anti")
    return (
        denied.select(F.lit("observed_but_denied").alias("kind"), "category", "subject", _reasons(DENIED).alias("reason"))
        .unionByName(unused.select(F.lit("unused_allowance").alias("kind"), "category", "subject", _reasons(UNUSED).alias("reason")))
    )


def findings_in_order(findings: DataFrame) -> DataFrame:
    """A report's order: each kind by category and subject."""
    return findings.orderBy(F.desc(F.col("kind") == "observed_but_denied"), "category", "subject")


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(inter, total, distance) of two sets of `subject`, without their categories; of two empty sets the distance is 0."""
    sides = a.select("subject", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("subject", F.lit(0).alias("a"), F.lit(1).alias("b")))
    keys = sides.groupBy("subject").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = keys.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("inter"), F.count("*").alias("total"))
    return out.select("inter", "total", F.coalesce(1 - F.try_divide(F.col("inter"), F.col("total")), F.lit(0.0)).alias("distance"))


def gap_summary(observed: DataFrame, policy: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(observed, denied, coverage_percent, drift): the universe is not tagged by category, findings are."""
    seen = _keys(observed, categories, False)
    findings = gap(observed, policy, categories).where("kind = 'observed_but_denied'").agg(F.count("*").alias("denied"))
    total = seen.select("subject").distinct().agg(F.count("*").alias("observed"))
    distance = jaccard(seen, _keys(policy, categories, False)).select(F.col("distance").alias("drift"))
    rows = total.crossJoin(F.broadcast(findings)).crossJoin(F.broadcast(distance))  # one row each
    return rows.select("observed", "denied", F.when(F.col("observed") > 0, F.greatest(F.col("observed") - F.col("denied"), F.lit(0)) / F.col("observed") * 100).otherwise(0.0).alias("coverage_percent"), "drift")
