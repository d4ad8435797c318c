"""Container metadata for events, and temporal joins with binds and open files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored
from .asof import asof


def two_tier(events: DataFrame, by_cgroup: DataFrame, by_ns: DataFrame) -> DataFrame:
    """Metadata by cgroup id; where that names no container, by the namespace pair; rows that have it keep theirs.

    `events`: cgroup_id, pid_ns, mnt_ns, container_id; dimensions: container_id, pod, namespace besides their key.
    The joins are plain: a dimension under the session's broadcast threshold is broadcast by its size.
    """
    has = F.coalesce(F.col("container_id"), F.lit("")) != ""
    a = by_cgroup.select("cgroup_id", *(F.col(c).alias(f"a_{c}") for c in ("container_id", "pod", "namespace")))
    b = by_ns.where("NOT (pid_ns = 0 AND mnt_ns = 0)").select("pid_ns", "mnt_ns", *(F.col(c).alias(f"b_{c}") for c in ("container_id", "pod", "namespace")))
    rows = events.withColumn("has", has).join(a, "cgroup_id", "left").join(b, ["pid_ns", "mnt_ns"], "left")
    use_a = F.coalesce(F.col("a_container_id"), F.lit("")) != ""
    pick = lambda c, own: F.when(F.col("has"), own).when(use_a, F.col(f"a_{c}")).otherwise(F.coalesce(F.col(f"b_{c}"), F.lit("")))
    out = rows.select(*(c for c in events.columns if c != "container_id"), pick("container_id", F.col("container_id")).alias("container_id"), pick("pod", F.lit("")).alias("pod"), pick("namespace", F.lit("")).alias("namespace"))
    return out


def containers_with_pods(containers: DataFrame, pods: DataFrame) -> DataFrame:
    """Containers with their sandbox's pod: first image that is named, pod labels under the container's own."""
    rows = containers.join(pods.select("pod_id", "pod", "namespace", F.col("labels").alias("pod_labels")), "pod_id", "left")
    image = F.coalesce(*(F.expr(f"nullif({c}, '')") for c in ("user_image", "image", "image_ref")), F.lit(""))
    own = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    under = F.map_filter(F.coalesce("pod_labels", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return rows.select("container_id", "pod_id", "pod", "namespace", image.alias("image"), F.map_concat(under, own).alias("labels"))


def live_peers(connects: DataFrame, binds: DataFrame, exits: DataFrame) -> DataFrame:
    """Connects with the latest live bind of their address, else of its port on all addresses; only of another container.

    Binds (seq, addr, port, pid, container_id); a bind dies at its owner's next exit.
    """
    owners = binds.select("seq", "ts_ns", "addr", "port", F.col("pid").alias("owner"), F.col("container_id").alias("owner_container"))
    ends = asof_next(owners, exits)
    wild = F.col("addr").isin("", "0.0.0.0", "::")
    exact = ends.where(~wild).select("seq", "ts_ns", F.concat("addr", F.lit(":"), "port").alias("peer"), "owner", "owner_container", "end_seq")
    any_ = ends.where(wild).select("seq", "ts_ns", "port", "owner", "owner_container", "end_seq")
    carry = ["owner", "owner_container", "end_seq"]
    a = asof(connects, exact, ["peer"], carry, prefix="x_")
    b = asof(a, any_, ["port"], carry, prefix="w_")
    alive = lambda p: F.col(f"{p}_at").isNotNull() & (F.col(f"{p}_end_seq").isNull() | (F.col(f"{p}_end_seq") > F.col("seq")))
    owner = F.when(alive("x"), F.col("x_owner")).when(alive("w"), F.col("w_owner"))
    box = F.when(alive("x"), F.col("x_owner_container")).when(alive("w"), F.col("w_owner_container"))
    return b.select(*connects.columns, owner.alias("owner"), box.alias("owner_container")).where("owner IS NOT NULL AND owner_container <> container_id")


def asof_next(binds: DataFrame, exits: DataFrame) -> DataFrame:
    """Adds end_seq, the owner's first exit after the bind."""
    a = binds.select("seq", "owner", F.lit(None).cast("long").alias("exit_seq"), F.struct(*binds.columns).alias("own"))
    b = exits.select("seq", F.col("pid").cast(binds.schema["owner"].dataType).alias("owner"), F.col("seq").alias("exit_seq"), F.lit(None).cast(a.schema["own"].dataType).alias("own"))
    w = Window.partitionBy("owner").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    rows = a.unionByName(b).withColumn("end_seq", F.first("exit_seq", ignorenulls=True).over(w)).where("own IS NOT NULL")
    return rows.select("own.*", "end_seq")


def dirfd_paths(opens: DataFrame) -> DataFrame:
    """Opens (seq, ts_ns, pid, fd, dirfd, path) with the whole path: a relative one stands on the latest open of its dirfd.

    An opened relative path can be a base itself, so bases are sought again until
    none is left, however deep; what has no rooted base then has no path.
    """
    rows = opens.withColumn("full", F.when(F.col("path").startswith("/"), F.col("path")))
    bases = opens.select("pid", F.col("fd").alias("dirfd"), "seq", "ts_ns", F.col("seq").alias("base_seq"))
    linked = asof(opens, bases, ["pid", "dirfd"], ["base_seq"]).select("seq", F.col("r_base_seq").alias("base_seq"))
    return _to_the_roots(rows.join(linked, "seq")).select(*opens.columns, "full")


def _to_the_roots(rows: DataFrame) -> DataFrame:
    """`full` for all rows (seq, base_seq, path, full) whose bases end at a rooted one.

    A round puts the tail of the base's base before a row's own, so depth doubles
    each time; bases come strictly earlier, so the rounds end.
    """
    steps = stored(rows.select("seq", "full", F.when(F.col("full").isNull(), F.col("base_seq")).alias("base_seq"), F.col("path").alias("tail")), "dirfd")
    while steps.where("full IS NULL AND base_seq IS NOT NULL").limit(1).count():
        base = steps.select(F.col("seq").alias("base_seq"), F.col("full").alias("b_full"), F.col("base_seq").alias("b_base"), F.col("tail").alias("b_tail"))
        joined = steps.join(base, "base_seq", "left")
        steps = stored(joined.select(
            "seq",
            F.coalesce("full", F.when(F.col("b_full").isNotNull(), F.concat_ws("/", "b_full", "tail"))).alias("full"),
            F.when(F.col("full").isNull() & F.col("b_full").isNull(), F.col("b_base")).alias("base_seq"),
            F.when(F.col("full").isNull() & F.col("b_full").isNull() & F.col("b_tail").isNotNull(), F.concat_ws("/", "b_tail", "tail")).otherwise(F.col("tail")).alias("tail"),
        ), "dirfd")
    return rows.drop("full").join(steps.select("seq", "full"), "seq")
