"""Profiles and contracts as documents: written sorted, read back as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The profile document's version, and its list of each category of items.
VERSION = 3
LISTS = {"exec": "execBinaries", "file": "filePaths", "file.write": "filePathsWrite", "peer": "egressPeers", "capability": "capabilities", "uid": "uids", "syscall": "syscallAllowlist"}
_HEADER = "schemaVersion int, id string, learnStart string, learnEnd string, sampleCount bigint, confidence double, rarityFreqFloor double, markovProbFloor double"
_DOCUMENT = _HEADER + ", " + ", ".join(f"{name} array<{'bigint' if name == 'uids' else 'string'}>" for name in LISTS.values())


def profile_documents(headers: DataFrame, items: DataFrame) -> DataFrame:
    """(profile_id, body): a JSON document a profile, its lists sorted and left out where empty.

    `headers`: profile_id, learn_start, learn_end (RFC 3339), samples, confidence, rarity_floor, markov_floor; `items`: profile_id, category, item.
    """
    number = F.expr("CASE WHEN category = 'uid' THEN bigint(item) END")
    sets = items.groupBy("profile_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("category") == c, number if c == "uid" else F.col("item")))).alias(name) for c, name in LISTS.items()))  # a profile's own items
    rows = headers.join(sets, "profile_id", "left").select(
        "profile_id", F.lit(VERSION).alias("schemaVersion"), F.col("profile_id").alias("id"), F.col("learn_start").alias("learnStart"), F.col("learn_end").alias("learnEnd"), F.col("samples").alias("sampleCount"), "confidence",
        *(F.when(F.size(name) > 0, F.col(name)).alias(name) for name in LISTS.values()), F.col("rarity_floor").alias("rarityFreqFloor"), F.col("markov_floor").alias("markovProbFloor"),
    )
    return rows.select("profile_id", F.to_json(F.struct(*[c for c in rows.columns if c != "profile_id"])).alias("body"))


def read_profiles(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, items) of `documents` (body); a version before the last has no written paths, so all of its paths read."""
    d = documents.select(F.from_json("body", _DOCUMENT).alias("d")).select("d.*")
    headers = d.select(F.col("id").alias("profile_id"), "schemaVersion", F.col("learnStart").alias("learn_start"), F.col("learnEnd").alias("learn_end"), F.col("sampleCount").alias("samples"), "confidence", F.col("rarityFreqFloor").alias("rarity_floor"), F.col("markovProbFloor").alias("markov_floor"))
    lists = F.array(*(F.struct(F.lit(c).alias("category"), F.col(name).cast("array<string>").alias("values")) for c, name in LISTS.items()))
    items = d.select(F.col("id").alias("profile_id"), F.explode(lists).alias("l")).select("profile_id", "l.category", F.explode("l.values").alias("item"))
    return headers, items


def contract_document(rules: DataFrame, contract_id: str, api_version: str = "tidewell/v1", kind: str = "BehaviorContract") -> str:
    """One contract's rules as a JSON document, sorted; contract.parse() reads it.  A contract is a document, so it fits the driver."""
    spec: dict = {"process": {"exec": []}, "file": {"read": [], "write": []}, "network": {"egress": []}, "capabilities": [], "syscalls": []}
    for r in sorted(rules.collect(), key=lambda r: (r.path_glob or r.path, r.peer, r.fqdn, r.binary, r.name)):
        if r.category == "exec":
            spec["process"]["exec"].append({"binary": r.binary})
        elif r.category.startswith("file."):
            spec["file"][r.category[5:]].append({"pathGlob": r.path_glob} if r.path_glob else {"path": r.path})
        elif r.category == "network.egress":
            spec["network"]["egress"].append({k: v for k, v in (("peer", r.peer), ("fqdn", r.fqdn)) if v})
        else:
            spec["capabilities" if r.category == "capability" else "syscalls"].append(r.name)
    return json.dumps({"apiVersion": api_version, "kind": kind, "metadata": {"contractID": contract_id}, "spec": spec}, indent=2)
