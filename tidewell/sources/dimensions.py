"""Dimension tables and documents: container listings, process and cgroup rows, DNS packets, several sources at once."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import container_of, pod_uid_of

_CONTAINERS = "containers array<struct<id:string,podSandboxId:string,metadata:struct<name:string>,image:struct<image:string,userSpecifiedImage:string>,imageRef:string,labels:map<string,string>>>"
_PODS = "items array<struct<id:string,metadata:struct<name:string,namespace:string,uid:string>,labels:map<string,string>>>"


def container_listing(spark: SparkSession, containers: str, pods: str) -> tuple[DataFrame, DataFrame]:
    """A runtime's container and pod listings (JSON files) as the tables that enrich.containers_with_pods() joins."""
    c = spark.read.schema(_CONTAINERS).option("multiLine", True).json(containers).select(F.explode("containers").alias("c"))
    p = spark.read.schema(_PODS).option("multiLine", True).json(pods).select(F.explode("items").alias("p"))
    return (
        c.selectExpr("c.id AS container_id", "c.podSandboxId AS pod_id", "c.metadata.name AS container", "c.image.userSpecifiedImage AS user_image", "c.image.image AS image", "c.imageRef AS image_ref", "c.labels AS labels"),
        p.selectExpr("p.id AS pod_id", "p.metadata.name AS pod", "p.metadata.namespace AS namespace", "p.metadata.uid AS uid", "p.labels AS labels"),
    )


def cgroup_index(lines: DataFrame) -> DataFrame:
    """(cgroup_id, container_id, pod_uid) of cgroup lines that name a container."""
    return lines.select("cgroup_id", container_of(F.col("line")).alias("container_id"), pod_uid_of(F.col("line")).alias("pod_uid")).where("container_id <> ''")


def dns_answers(raw: bytes) -> list[tuple[str, str]]:
    """(name asked for, address) of each A record of a DNS response; nothing for queries and broken packets."""

    def name(at: int, hops: int = 0) -> tuple[str, int]:
        labels = []
        while True:
            n = raw[at]
            if n >= 0xC0:
                if hops > 8:
                    raise ValueError
                rest, _ = name((n & 0x3F) << 8 | raw[at + 1], hops + 1)
                return ".".join([*labels, rest]).strip("."), at + 2
            if n == 0:
                return ".".join(labels), at + 1
            labels.append(raw[at + 1 : at + 1 + n].decode("ascii", "replace"))
            at += n + 1

    try:
        _, flags, asked, answers, _, _ = struct.unpack_from(">6H", raw)
        if not flags & 0x8000 or asked < 1:
            return []
        query, at = name(12)
        at += 4
        for _ in range(asked - 1):
            _, at = name(at)
            at += 4
        out = []
        for _ in range(answers):
            _, at = name(at)
            kind, _, _, size = struct.unpack_from(">HHIH", raw, at)
            at += 10
            if kind == 1 and size == 4 and at + 4 <= len(raw):
                out.append((query, ".".join(map(str, raw[at : at + 4]))))
            at += size
        return out
    except (IndexError, struct.error, ValueError):
        return []


def dns_events(packets: DataFrame) -> DataFrame:
    """(seq, ts_ns, query, ip): an event for each A record in `packets` (seq, ts_ns, raw)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, t, q, ip) for s, t, raw in zip(pdf["seq"], pdf["ts_ns"], pdf["raw"]) for q, ip in dns_answers(bytes(raw or b""))]
            yield pd.DataFrame(rows, columns=["seq", "ts_ns", "query", "ip"])

    return packets.select("seq", "ts_ns", "raw").mapInPandas(run, "seq long, ts_ns long, query string, ip string")


def dns_intents(answers: DataFrame, by_cgroup: DataFrame) -> DataFrame:
    """A DNSAnswer intent for each answer (seq, ts_ns, query, addr, rtype, cgroup_id, container_id, pod, namespace) with a query and an address.

    Its container is the one of its cgroup in `by_cgroup` (cgroup_id, container_id, pod, namespace), where that names one, else its own.
    """
    rows = answers.where("query <> '' AND addr <> ''")
    meta = by_cgroup.where("cgroup_id <> 0 AND (container_id <> '' OR pod <> '')").select("cgroup_id", F.struct("container_id", "pod", "namespace").alias("of_cgroup"))
    rows = rows.join(meta, "cgroup_id", "left").withColumn("meta", F.coalesce("of_cgroup", F.struct("container_id", "pod", "namespace")))
    return rows.select(
        "seq", F.lit("DNSAnswer").alias("kind"), F.col("ts_ns").alias("start_ns"), F.col("ts_ns").alias("end_ns"),
        F.create_map(F.lit("query"), "query", F.lit("addr"), "addr", F.lit("rtype"), F.coalesce("rtype", F.lit(""))).alias("attributes"), "meta", F.lit(1).alias("severity"), F.lit(1.0).alias("confidence"),
    )


def docker_listing(spark: SparkSession, path: str) -> DataFrame:
    """A Docker listing (a JSON array of containers) as a table: container_id, container, image, labels."""
    rows = spark.read.schema("Id string, Names array<string>, Image string, Labels map<string,string>").option("multiLine", True).json(path)
    return rows.selectExpr("Id AS container_id", "coalesce(ltrim('/', Names[0]), '') AS container", "Image AS image", "Labels AS labels")


def namespace_index(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(pid_ns, mnt_ns, pid): the first process of each namespace pair, from rows (pid, pid_link, mnt_link) as procfs spells them, `pid:[4026531836]`."""
    inode = lambda c: F.expr(f"bigint(regexp_extract({c}, '\\\\[([0-9]+)\\\\]', 1))")
    rows = links.where(F.col("pid_link").rlike(r"^pid:\[[0-9]+\]$") & F.col("mnt_link").rlike(r"^mnt:\[[0-9]+\]$")).select("pid", inode("pid_link").alias("pid_ns"), inode("mnt_link").alias("mnt_ns"))
    return rows.groupBy("pid_ns", "mnt_ns").agg(F.min("pid").alias("pid"))


def pumped(sources: list[DataFrame], corrupt: str = "error") -> tuple[DataFrame, DataFrame]:
    """Several sources as one: (sound rows, counts of the broken ones by what is wrong)."""
    rows = reduce(DataFrame.unionByName, sources)
    return rows.where(F.col(corrupt).isNull()).drop(corrupt), rows.where(F.col(corrupt).isNotNull()).groupBy(corrupt).agg(F.count("*").alias("n"))


def active_model(lifecycle: DataFrame) -> DataFrame:
    """The profile in force of each workload after `lifecycle` (seq, workload, action, profile_id): activate sets it, deactivate and reset clear it."""
    last = lifecycle.where("action IN ('activate', 'deactivate', 'reset')").groupBy("workload").agg(F.max_by(F.struct("action", "profile_id"), "seq").alias("x"))
    return last.where("x.action = 'activate'").select("workload", "x.profile_id")


def snapshot(sessions: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """What a new subscriber is told first: open sessions and the last state of each container."""
    states = lifecycle.groupBy("container_id").agg(F.max_by("kind", "seq").alias("state"))
    return sessions.select(F.lit("session").alias("what"), F.col("session_id").alias("key"), F.lit("open").alias("state")).unionByName(states.select(F.lit("container").alias("what"), F.col("container_id").alias("key"), "state"))
