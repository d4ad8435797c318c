"""What a node can observe: a table of hooks, and the report on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The hooks that are looked for besides the node's own tracepoints, and what is said of those that are missing.
LSM_HOOKS = ["bprm_check_security", "file_open", "task_kill", "socket_connect", "inode_unlink", "sb_mount"]
KPROBES = [
    "security_bprm_check", "security_file_open", "security_task_kill", "security_path_chmod", "security_path_chown", "security_path_unlink", "security_path_rename", "security_path_link", "security_path_mkdir",
    "security_path_rmdir", "security_path_chroot", "filp_close", "cap_capable", "security_socket_connect", "security_socket_bind", "security_socket_sendmsg", "security_socket_recvmsg",
]
NO_SYMBOL = "not in kallsyms/available_filter_functions"
NO_LSM, NO_LIST = "lsm=bpf boot param missing", "LSM list not readable"


def discover(tracepoints: DataFrame, symbols: DataFrame, lsms: list[str] | None) -> DataFrame:
    """Hooks (kind, name, available, reason, fallback) from a node's tracepoints and symbols (name) and its security modules (None: not known)."""
    spark = tracepoints.sparkSession
    traced = tracepoints.select("name").distinct().select(F.lit("syscall_tracepoint").alias("kind"), "name", F.lit(True).alias("available"), F.lit("").alias("reason"), F.lit("").alias("fallback"))
    has, no_lsm = "bpf" in (lsms or []), NO_LIST if lsms is None else NO_LSM
    lsm = spark.createDataFrame([("lsm_bpf", h, has, "" if has else no_lsm, "" if has else "kprobe:security_" + h.removesuffix("_security")) for h in LSM_HOOKS], "kind string, name string, available boolean, reason string, fallback string")
    wanted = spark.createDataFrame([(k,) for k in KPROBES], "name string")
    found = wanted.join(symbols.select("name").distinct().withColumn("there", F.lit(True)), "name", "left").withColumn("available", F.coalesce("there", F.lit(False)))
    probes = found.select(F.lit("kprobe").alias("kind"), "name", "available", F.when(F.col("available"), "").otherwise(NO_SYMBOL).alias("reason"), F.lit("").alias("fallback"))
    return traced.unionByName(lsm).unionByName(probes)


def diagnose(hooks: DataFrame) -> DataFrame:
    """(probe, state, warning): a hook with a fallback is on that, whatever else; a missing one warns with its reason."""
    probe = F.concat("kind", F.lit("/"), "name")
    state = F.when(F.col("fallback") != "", "fallback").when(F.col("available"), "ok").otherwise("missing")
    return hooks.select(probe.alias("probe"), state.alias("state"), F.when(~F.col("available") & (F.col("reason") != ""), F.concat(probe, F.lit(": "), "reason")).otherwise("").alias("warning"))
