"""Hook subscriptions and the control plane's tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CORRELATIONS

PAIRINGS, ON_MISSING, LEVELS = ("enter_only", "exit_only", "enter_exit"), ("fail", "skip", "fallback"), ("full", "minimal", "none")


@dataclass
class Subscription:
    name: str
    syscalls: list[str] = field(default_factory=list)
    lsm: list[str] = field(default_factory=list)
    tracepoints: list[str] = field(default_factory=list)
    kprobes: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    critical: list[str] = field(default_factory=list)
    sampling: dict[str, str] = field(default_factory=dict)
    fallback: dict[str, str] = field(default_factory=dict)
    pairing: str = "enter_exit"
    on_missing: str = "fail"
    level: str = "full"
    history_depth: int = 32
    history_secs: int = 30
    correlations: list[str] | None = None

    def __post_init__(self):
        for value, known, what in ((self.pairing, PAIRINGS, "pairing"), (self.on_missing, ON_MISSING, "onMissing"), (self.level, LEVELS, "level")):
            if value not in known:
                raise ValueError(f"{what} must be one of {', '.join(known)}: {value!r}")
        if not self.name:
            raise ValueError("a subscription needs a name")
        if unknown := set(self.correlations or ()) - set(CORRELATIONS):
            raise ValueError(f"unknown correlations: {sorted(unknown)}")


def parse(doc: dict) -> Subscription:
    """A subscription document with its defaults."""
    if doc.get("kind") != "HookSubscription":
        raise ValueError("kind must be HookSubscription")
    spec = doc.get("spec") or {}
    lists = {k: (spec.get(n) or {}) for k, n in (("syscalls", "syscalls"), ("lsm", "lsm"), ("tracepoints", "tracepoint"), ("kprobes", "kprobe"))}
    enrich, graceful = spec.get("enrichment") or {}, spec.get("graceful") or {}
    return Subscription(
        name=(doc.get("metadata") or {}).get("name", ""), **{k: [n for n in v.get("include") or [] if n not in (v.get("exclude") or [])] for k, v in lists.items()},
        critical=(spec.get("priority") or {}).get("critical") or [], sampling=spec.get("sampling") or {}, fallback=graceful.get("fallback") or {},
        pairing=spec.get("pairing") or "enter_exit", on_missing=graceful.get("onMissing") or "fail", level=enrich.get("level") or "full",
        history_depth=enrich.get("historyDepth") or 32, history_secs=enrich.get("historyWindowSecs") or 30, correlations=enrich.get("correlations") or None,
    )


# The presets.
PRESETS = {
    "security-minimal": dict(syscalls="execve execveat setuid setgid ptrace", critical="execve execveat ptrace setuid setgid"),
    "security-standard": dict(
        syscalls="execve execveat openat openat2 connect accept accept4 ptrace setuid setgid capset unshare setns chmod fchmod fchmodat mount umount2",
        lsm="bprm_check_security file_open task_kill socket_connect", critical="execve execveat ptrace connect setuid capset bprm_check_security",
        correlations="file_written_then_executed connect_after_dns exec_after_chmod_x", on_missing="fallback", sampling={"openat": "1/10"},
        fallback={"bprm_check_security": "kprobe:security_bprm_check", "file_open": "kprobe:security_file_open", "openat2": "syscall_tracepoint:openat"},
    ),
    "forensics-full": dict(
        syscalls="""execve execveat clone clone3 openat openat2 open close read write connect accept accept4 bind listen socket sendto recvfrom ptrace setuid setgid
          setreuid setregid capset unshare setns mount umount2 chroot chmod fchmod fchmodat unlink unlinkat rename renameat renameat2 link linkat symlink symlinkat mkdir mkdirat rmdir""",
        lsm="bprm_check_security file_open task_kill socket_connect inode_unlink sb_mount", critical="execve execveat ptrace connect setuid capset mount",
        history_depth=64, history_secs=120, correlations="file_written_then_executed connect_after_dns exec_after_chmod_x read_sensitive_before_send privilege_escalation_window",
    ),
    "network-only": dict(syscalls="socket bind connect accept accept4 listen sendto recvfrom", lsm="socket_connect", critical="connect accept accept4", level="minimal", history_depth=8, history_secs=15),
}


def preset(name: str) -> Subscription | None:
    if name not in PRESETS:
        return None
    made = {k: v.split() if isinstance(v, str) and k not in ("level", "on_missing") else v for k, v in PRESETS[name].items()}
    return Subscription(name=name, **{"on_missing": "skip"} | made)


def wants(spark: SparkSession, sub: Subscription) -> DataFrame:
    """(nth, kind, hook, priority, sample, fallback): one row a wanted hook, in document order."""
    rows = [(k, n) for k, ns in (("syscall_tracepoint", sub.syscalls), ("lsm_bpf", sub.lsm), ("tracepoint", sub.tracepoints), ("kprobe", sub.kprobes)) for n in ns if n not in sub.excluded]
    return spark.createDataFrame([(i, k, n, "critical" if n in sub.critical else "normal", sub.sampling.get(n, ""), sub.fallback.get(n, "")) for i, (k, n) in enumerate(rows)], "nth int, kind string, hook string, priority string, sample string, fallback string")


def resolve(wanted: DataFrame, capabilities: DataFrame, on_missing: str) -> DataFrame:
    """Each wanted hook with `status` attach, fallback or skip, what is attached, and the reason where nothing is.

    `capabilities`: kind, hook, available, reason.
    """
    a = capabilities.select("kind", "hook", F.col("available").alias("ok"), F.col("reason").alias("why"))
    b = capabilities.select(F.concat("kind", F.lit(":"), "hook").alias("fallback"), F.col("available").alias("alt_ok"))
    rows = wanted.join(a, ["kind", "hook"], "left").join(b, "fallback", "left")
    ok, reason = F.coalesce("ok", F.lit(False)), F.coalesce("why", F.lit("hook_not_found"))
    alt = F.lit(on_missing == "fallback")
    status = F.when(ok, "attach").when(alt & F.coalesce("alt_ok", F.lit(False)), "fallback").otherwise("skip")
    why = (
        F.when(ok | (status == "fallback"), "").when(~alt, reason).when(F.col("fallback") == "", F.concat(reason, F.lit(" (no fallback)")))
        .when(~F.col("fallback").rlike("^[^:]+:.+$"), F.concat(F.lit("malformed fallback "), "fallback")).otherwise(F.concat(F.lit("fallback "), "fallback", F.lit(" also unavailable")))
    )
    attached = F.when(ok, F.concat("kind", F.lit(":"), "hook")).when(status == "fallback", F.col("fallback")).otherwise("")
    return rows.select("nth", "kind", "hook", "priority", "sample", status.alias("status"), attached.alias("attached"), why.alias("reason"))


def apply_all(requests: DataFrame) -> DataFrame:
    """The policy registry after `requests` (seq, kind, name, action, valid): the latest valid one of each key, unless a delete."""
    w = Window.partitionBy("kind", "name").orderBy(F.desc("seq"))
    return requests.where("valid").withColumn("nth", F.row_number().over(w)).where("nth = 1 AND action <> 'delete'").drop("nth").orderBy(F.concat("kind", F.lit("|"), "name"))


def outcomes(requests: DataFrame) -> DataFrame:
    return requests.groupBy("kind", F.when(F.col("valid"), "ok").otherwise("rejected").alias("result")).agg(F.count("*").alias("n"))


def validate(kind: str, doc: dict) -> str:
    """'' for a sound document, else what is wrong; kinds without a rule pass."""
    if kind != "HookSubscription":
        return ""
    try:
        parse(doc)
    except ValueError as e:
        return str(e)
    return ""


class Config:
    """Runtime settings by key; setting reports each key's result."""

    def __init__(self, **known: str):
        self.values = dict(known)

    def set(self, **changes: str) -> dict[str, str]:
        out = {}
        for k, v in changes.items():
            if k in self.values:
                self.values[k] = v
                out[k] = "applied"
            else:
                out[k] = "unknown key"
        return out


def thresholds(text: str) -> tuple[float, ...]:
    """Comma-separated rising thresholds between 0 and 1."""
    values = tuple(float(x) for x in text.split(","))
    if any(not 0 <= v <= 1 for v in values) or list(values) != sorted(set(values)):
        raise ValueError(f"thresholds must rise between 0 and 1: {text!r}")
    return values
