"""Small conversions, all as built-in column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of capabilities 0 to 40, prctl options, namespace flags of clone in their order, severities.
CAPABILITIES = """CHOWN DAC_OVERRIDE DAC_READ_SEARCH FOWNER FSETID KILL SETGID SETUID SETPCAP LINUX_IMMUTABLE NET_BIND_SERVICE
 NET_BROADCAST NET_ADMIN NET_RAW IPC_LOCK IPC_OWNER SYS_MODULE SYS_RAWIO SYS_CHROOT SYS_PTRACE SYS_PACCT SYS_ADMIN SYS_BOOT
 SYS_NICE SYS_RESOURCE SYS_TIME SYS_TTY_CONFIG MKNOD LEASE AUDIT_WRITE AUDIT_CONTROL SETFCAP MAC_OVERRIDE MAC_ADMIN SYSLOG
 WAKE_ALARM BLOCK_SUSPEND AUDIT_READ PERFMON BPF CHECKPOINT_RESTORE""".split()
PRCTL = {4: "PR_SET_DUMPABLE", 8: "PR_SET_KEEPCAPS", 22: "PR_SET_SECCOMP", 23: "PR_CAPBSET_READ", 24: "PR_CAPBSET_DROP", 38: "PR_SET_NO_NEW_PRIVS", 39: "PR_GET_NO_NEW_PRIVS", 47: "PR_CAP_AMBIENT"}
CLONE = {"NEWNS": 0x20000, "NEWUTS": 0x4000000, "NEWIPC": 0x8000000, "NEWUSER": 0x10000000, "NEWPID": 0x20000000, "NEWNET": 0x40000000, "NEWCGROUP": 0x2000000, "NEWTIME": 0x80}
SEVERITY = ("unknown", "low", "medium", "high", "critical")
UNCHANGED = 0xFFFFFFFF


def lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain(*table.items()))), key)


def ret_code(value: Column) -> Column:
    return F.when(value == 0, "SUCCESS").otherwise(value.cast("string"))


def opens_for_write(flags: Column) -> Column:
    """Access mode write or both, or the create or truncate bit."""
    mode = flags.bitwiseAND(3)
    return mode.isin(1, 2) | (flags.bitwiseAND(0x40 | 0x200) != 0)


def ipv4(addr: Column) -> Column:
    """Dotted form of an address whose first octet is the lowest byte."""
    return F.concat_ws(".", *(F.shiftright(addr, 8 * k).bitwiseAND(255).cast("string") for k in range(4)))


def sock_addr(family: Column, addr: Column, port: Column, path: Column) -> Column:
    return F.when(family == 1, F.coalesce(path, F.lit(""))).when(family == 2, F.concat(ipv4(addr), F.lit(":"), port.cast("string"))).otherwise("")


def cap_name(n: Column) -> Column:
    return F.coalesce(lookup(n, {k: "CAP_" + c for k, c in enumerate(CAPABILITIES)}), F.concat(F.lit("CAP_"), n.cast("string")))


def prctl_name(option: Column) -> Column:
    return F.coalesce(lookup(option, PRCTL), F.lit(""))


def clone_flags(flags: Column) -> Column:
    return F.concat_ws("|", *(F.when(flags.bitwiseAND(F.lit(bit).cast("long")) != 0, "CLONE_" + name) for name, bit in CLONE.items()))


def makes_namespace(flags: Column) -> Column:
    """Any namespace bit; an absent or unreadable flag counts as one."""
    value = flags.try_cast("bigint")
    return F.coalesce(value.bitwiseAND(F.lit(sum(CLONE.values())).cast("long")) != 0, F.lit(True))


def id_value(value: Column) -> Column:
    return F.when(value == UNCHANGED, "unchanged").otherwise(value.cast("string"))


def host_of(addr: Column) -> Column:
    """What stands before the last colon, without brackets; the whole where there is none."""
    return F.regexp_replace(F.when(addr.contains(":"), F.regexp_extract(addr, r"^(.*):[^:]*$", 1)).otherwise(addr), r"^\[(.*)\]$", "$1")


def port_of(addr: Column) -> Column:
    return F.when(addr.contains(":"), F.regexp_extract(addr, r":([^:]*)$", 1)).otherwise("")


def leading_int(text: Column) -> Column:
    """The digits that a string starts with (0: none)."""
    return F.coalesce(F.regexp_extract(text, r"^(\d+)", 1).try_cast("bigint"), F.lit(0).cast("long"))


def whole_int(text: Column) -> Column:
    """The number a string of digits is; 0 for anything else."""
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")).otherwise(F.lit(0).cast("long"))


def arg(args: Column, name: str) -> Column:
    """The value of the first argument of that name."""
    return F.try_element_at(F.filter(args, lambda a: a["name"] == name), F.lit(1))["value"]


def argv(parts: Column) -> Column:
    return F.translate(F.array_join(parts, " "), "\n\r\t", "   ")


def severity_name(level: Column) -> Column:
    return F.coalesce(lookup(level, dict(enumerate(SEVERITY))), F.lit("unknown"))


def severity_level(name: Column) -> Column:
    return F.coalesce(lookup(name, {s: k for k, s in enumerate(SEVERITY)}), F.lit(0))


def container_of(line: Column) -> Column:
    """The container id in a cgroup line: the first path part with a runtime's prefix, or of 32 hex digits or more."""
    parts = F.transform(F.split(F.regexp_extract(line, r"([^:]*)$", 1), "/"), lambda p: F.regexp_replace(p, r"\.(scope|service)$", ""))
    ids = F.transform(parts, lambda p: F.when(p.rlike(r"^(cri-containerd|containerd|crio|libpod|docker)-"), F.regexp_replace(p, r"^(cri-containerd|containerd|crio|libpod|docker)-", "")).when(p.rlike(r"^[0-9a-fA-F]{32,}$"), p).otherwise(""))
    return F.coalesce(F.try_element_at(F.filter(ids, lambda i: i != ""), F.lit(1)), F.lit(""))


def pod_uid_of(line: Column) -> Column:
    """The pod's uid in a cgroup line, as the slice spells it."""
    parts = F.filter(F.split(F.regexp_extract(line, r"([^:]*)$", 1), "/"), lambda p: p.rlike(r"^kubepods.*?-pod."))
    found = F.transform(parts, lambda p: F.regexp_replace(F.regexp_extract(p, r"^kubepods.*?-pod(.*)$", 1), r"\.(slice|scope)$", ""))
    return F.coalesce(F.try_element_at(F.filter(found, lambda u: u != ""), F.lit(1)), F.lit(""))


def clean_path(path: Column) -> Column:
    """A rooted path without `.`, `..` and doubled slashes, by a fold over its parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def joined_path(base: Column, path: Column) -> Column:
    return F.when(path.startswith("/"), clean_path(path)).otherwise(clean_path(F.concat_ws("/", base, path)))


def path_tail(path: Column, n: int = 32) -> Column:
    return F.when(F.length(path) <= n, path).otherwise(F.concat(F.lit("..."), F.substring(path, -(n - 3), n - 3)))


# The directory descriptor that means the working directory, and why a path stays unresolved.
AT_FDCWD = -100
FD_MISS, TOO_LONG, PROC_MISS, NULL_BYTE, EMPTY = "fd_table_miss", "path_too_long", "proc_lookup_failed", "path_contains_null", "empty_input"


def resolved_path(raw: Column, dirfd: Column, fd_path: Column, fd_socket: Column, cwd: Column, longest: int = 0) -> Column:
    """struct(path, reason, hint): the whole path, or why there is none with a tail of what was given.

    `fd_path` and `fd_socket` are what the process's descriptor table says of
    `dirfd`, `cwd` its working directory, null where the lookup failed.  No
    longer than `longest` bytes, if that is not 0.
    """
    raw = F.coalesce(raw, F.lit(""))
    here = dirfd == AT_FDCWD
    nul = F.contains(raw, F.lit("\0"))
    no_dir = F.coalesce(fd_path, F.lit("")).eqNullSafe("") | F.coalesce(fd_socket, F.lit(False))
    early = (
        F.when((raw == "") & here, EMPTY).when(nul, NULL_BYTE).when((raw == "") & fd_path.isNull(), FD_MISS)
        .when((raw == "") | raw.startswith("/"), F.lit(None)).when(here & cwd.isNull(), PROC_MISS).when(~here & no_dir, FD_MISS)
    )
    base = F.when(raw == "", fd_path).when(raw.startswith("/"), raw).when(here, F.concat(cwd, F.lit("/"), raw)).otherwise(F.concat(fd_path, F.lit("/"), raw))
    whole = F.when(early.isNull(), F.when(base.startswith("/"), clean_path(base)).otherwise(base))
    long_ = (F.octet_length(whole) > longest) if longest else F.lit(False)
    reason = F.when(early.isNotNull(), early).when(long_, TOO_LONG).otherwise("")
    hint = F.when(early == EMPTY, "").when(early.isNotNull(), path_tail(raw)).when(long_, path_tail(whole)).otherwise("")
    return F.struct(F.when(reason == "", whole).otherwise("").alias("path"), reason.alias("reason"), hint.alias("hint"))


def summary(kind: Column, attributes: Column) -> Column:
    """One line for an intent."""
    get = lambda k: F.coalesce(F.try_element_at(attributes, F.lit(k)), F.lit(""))
    return (
        F.when(kind == "ProcessStart", get("binary")).when(kind.startswith("File"), get("path")).when(kind == "NetworkExchange", get("peer"))
        .when(kind == "DNSAnswer", F.concat(get("query"), F.lit(" → "), get("addr"))).otherwise(kind)
    )
