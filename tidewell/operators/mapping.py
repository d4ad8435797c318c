"""Decoded frames to events: names, categories, operations, resources and named arguments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

REAL_BELOW = 1000

# x86-64 numbers of the calls that have a mapping of their own, and the numbers of hooks that are no calls.
NUMBERS = dict(
    open=2, close=3, mmap=9, mprotect=10, socket=41, connect=42, accept=43, sendmsg=46, recvmsg=47, bind=49, listen=50, clone=56, execve=59, kill=62,
    rename=82, mkdir=83, rmdir=84, link=86, unlink=87, symlink=88, chmod=90, fchmod=91, chown=92, fchown=93, lchown=94, ptrace=101, setuid=105, setgid=106, setreuid=113, setregid=114,
    setresuid=117, setresgid=119, setfsuid=122, setfsgid=123, capset=126, prctl=157, chroot=161, mount=165, umount2=166, tgkill=234, openat=257, mkdirat=258,
    fchownat=260, unlinkat=263, renameat=264, linkat=265, symlinkat=266, fchmodat=268, unshare=272, accept4=288, recvmmsg=299, sendmmsg=307, setns=308,
    renameat2=316, execveat=322, clone3=435, openat2=437,
)
HOOKS = """sched_process_exit security_bprm_check security_task_kill security_path_chroot security_file_open filp_close security_path_chown security_path_chmod
 security_path_unlink security_path_rename security_path_link security_path_mkdir security_path_rmdir cap_capable security_socket_connect security_socket_bind
 security_socket_sendmsg security_socket_recvmsg dns_answer""".split()

# Calls -> category, operation ("" for the call's own name), place of the resource (-1: none), named arguments by place.
CALLS = [
    ("execve execveat", "process", "execute", 0, "argv:1"),
    ("clone clone3 unshare", "process", "", -1, "flags:0"),
    ("setns", "process", "", -1, "flags:1"),
    ("kill tgkill", "process", "kill", -1, "pid:0 sig:1"),
    ("setuid setreuid setresuid setfsuid", "creds", "setuid", -1, ""),
    ("setgid setregid setresgid setfsgid", "creds", "setgid", -1, ""),
    ("capset", "creds", "capset", -1, ""),
    ("cap_capable", "creds", "cap_capable", -1, "cap:0 opts:1"),
    ("prctl", "process", "prctl", -1, "option:0 arg2:1"),
    ("mmap mprotect", "process", "exec_map", -1, "addr:0 length:1 prot:2"),
    ("chroot", "process", "chroot", 0, ""),
    ("ptrace", "process", "ptrace", -1, "request:0 pid:1"),
    ("open openat openat2", "file", "open", -1, ""),
    ("close", "file", "close", -1, "fd:0"),
    ("chmod fchmodat", "file", "chmod", 0, ""),
    ("fchmod", "file", "chmod", -1, "fd:0"),
    ("chown fchownat lchown", "file", "chown", 0, ""),
    ("fchown", "file", "chown", -1, "fd:0"),
    ("unlink unlinkat", "file", "unlink", 0, ""),
    ("rename renameat renameat2", "file", "rename", 0, "oldpath:0 newpath:1"),
    ("link linkat symlink symlinkat", "file", "", 0, ""),
    ("mkdir mkdirat", "file", "mkdir", 0, ""),
    ("rmdir", "file", "rmdir", 0, ""),
    ("mount", "file", "mount", 1, ""),
    ("umount2", "file", "umount", 0, ""),
    ("socket", "network", "socket", -1, ""),
    ("bind", "network", "bind", -1, "fd:0"),
    ("connect", "network", "connect", -1, "fd:0"),
    ("listen", "network", "listen", -1, "fd:0"),
    ("accept accept4", "network", "accept", -1, "fd:0"),
    ("sendmsg sendmmsg", "network", "send", -1, "fd:0"),
    ("recvmsg recvmmsg", "network", "recv", -1, "fd:0"),
    ("sched_process_exit", "process", "exit", 0, ""),
    ("security_bprm_check security_file_open security_path_chroot security_path_chmod security_path_chown security_path_unlink security_path_mkdir security_path_rmdir security_path_link security_path_symlink", "security", "", 0, ""),
    ("security_path_rename", "security", "", 0, "oldpath:0 newpath:1"),
    ("security_task_kill", "security", "", -1, ""),
    ("security_socket_connect security_socket_bind security_socket_sendmsg security_socket_recvmsg", "security", "", -1, ""),
    ("dns_answer", "network", "dns_answer", 0, "rtype:1 cgroup_id:3"),
]


def call_names(spark: SparkSession, header: str | None = None) -> DataFrame:
    """(syscall_id, syscall_name): from a system header of `#define __NR_name number` lines where one is given, and the hooks."""
    known = dict(NUMBERS)
    if header:
        text = "\n".join(r[0] for r in spark.read.text(header).collect())
        known |= {n: int(k) for n, k in re.findall(r"#define\s+__NR_(\w+)\s+(\d+)", text)}
    rows = [(k, n) for n, k in known.items()] + [(REAL_BELOW + k, n) for k, n in enumerate(HOOKS)]
    return spark.createDataFrame(rows, "syscall_id int, syscall_name string")


def named(frames: DataFrame, names: DataFrame) -> DataFrame:
    """Adds syscall_name; unknown numbers are named by number.  `names` has a row a system call."""
    found = frames.join(names, "syscall_id", "left")
    return found.withColumn("syscall_name", F.coalesce("syscall_name", F.concat(F.lit("syscall_"), F.col("syscall_id").cast("string"))))


def _table() -> dict[str, tuple]:
    return {n: row[1:] for row in CALLS for n in row[0].split()}


def _pick(values: dict) -> Column:
    return scalars.lookup(F.col("syscall_name"), values)


def map_frames(frames: DataFrame) -> DataFrame:
    """`frames` (syscall_name, args array<struct<type,value,parts>>, retval, ...) as events.

    Adds category, operation, resource, comm, exe_path, ret_code and `named`, the
    arguments by name in order.  Frames without arguments are of the category
    `default`, whatever the call.
    """
    table = _table()
    at = lambda k: F.try_element_at("args", F.lit(k + 1))
    value = lambda k: F.coalesce(at(k)["value"], F.lit(""))
    kind = lambda k: F.coalesce(at(k)["type"], F.lit(""))
    number = lambda k: at(k)["value"].try_cast("bigint")
    name, n = F.col("syscall_name"), F.size("args")
    is_ = lambda names: name.isin(names.split())

    category = F.coalesce(_pick({k: v[0] for k, v in table.items()}), F.lit("default"))
    operation = F.coalesce(F.expr("nullif(op0, '')"), name)
    by_place = F.when(F.col("res0") >= 0, F.coalesce(F.try_element_at("args", F.col("res0") + 1)["value"], F.lit("")))
    has_dirfd = is_("openat openat2") & (kind(0) == "int")
    path, flags = F.when(has_dirfd, value(1)).otherwise(value(0)), F.when(has_dirfd, number(2)).otherwise(number(1))
    opens = is_("open openat openat2")
    addr = lambda k: F.when(kind(k) == "int", scalars.sock_addr(number(k), number(k + 1), F.coalesce(at(k + 2)["value"], F.lit("")), at(k + 1)["value"])).otherwise("")
    socket_hook = F.startswith(name, F.lit("security_socket_"))
    resource = (
        F.when(opens, path).when(is_("bind connect"), addr(1)).when(socket_hook, addr(0)).when(name == "cap_capable", scalars.cap_name(number(0).cast("int")))
        .when(name == "prctl", scalars.prctl_name(number(0).cast("int"))).when((name == "close") & (n >= 3) & kind(1).isin("str", "resource", "strref"), value(1)).otherwise(F.coalesce(by_place, F.lit("")))
    )
    entry = lambda key, v, when: F.when(when & v.isNotNull(), F.struct(F.lit(key).alias("name"), v.cast("string").alias("value")))
    plain = []
    for key, places in _by_argument(table).items():
        for place, calls in places.items():
            text = F.array_join(F.transform(at(place)["parts"], lambda p: p), " ") if key == "argv" else at(place)["value"]
            plain.append(entry(key, text, name.isin(calls)))
    flag_place = F.when(name == "setns", number(1).bitwiseAND(0xFFFFFFFF)).otherwise(number(0))
    ns = scalars.clone_flags(flag_place)
    which = F.when(F.col("op0") == "setgid", "gid").otherwise("uid")
    single, double, triple = is_("setuid setgid setfsuid setfsgid"), is_("setreuid setregid"), is_("setresuid setresgid")
    new = F.when(single, number(0)).when(double | triple, number(1))
    cred = lambda prefix, k, when: F.when(when & number(k).isNotNull(), F.struct(F.concat(F.lit(prefix), which).alias("name"), scalars.id_value(number(k).bitwiseAND(0xFFFFFFFF)).alias("value")))
    extra = [
        entry("dirfd", at(0)["value"], has_dirfd), entry("flags", flags, opens), entry("ns_flags", F.when(ns != "", ns), is_("clone clone3 unshare setns")),
        entry("path", at(1)["value"], (name == "close") & (n >= 3) & kind(1).isin("str", "resource", "strref") & (value(1) != "")), entry("open_ts_ns", at(2)["value"], (name == "close") & (n >= 3) & (kind(2) == "ulong")),
        entry("peer_pid", at(4)["value"], (name == "connect") & (kind(4) == "uint") & (value(4) != "0")), entry("is_mmsg", F.lit("1"), is_("sendmmsg recvmmsg")),
        entry("addr", scalars.ipv4(number(2)), (name == "dns_answer") & (kind(2) == "uint")),
        cred("", 0, single), cred("r", 0, double | triple), cred("e", 1, double | triple), cred("s", 2, triple),
        F.when(new.isNotNull() & (new.bitwiseAND(0xFFFFFFFF) != scalars.UNCHANGED), F.struct(F.concat(F.lit("new_"), which).alias("name"), new.bitwiseAND(0xFFFFFFFF).cast("string").alias("value"))),
    ]
    last = F.try_element_at("args", n)
    rows = frames.withColumn("op0", F.coalesce(_pick({k: v[1] for k, v in table.items()}), F.lit(""))).withColumn("res0", F.coalesce(_pick({k: v[2] for k, v in table.items()}), F.lit(-1)))
    empty = n == 0
    return rows.select(
        *frames.columns,
        F.when(empty, "default").otherwise(category).alias("category"),
        F.when(empty, name).when(opens & F.coalesce(scalars.opens_for_write(flags), F.lit(False)), "open_write").otherwise(operation).alias("operation"),
        F.when(empty, "").otherwise(resource).alias("resource"),
        F.when(last["type"].isin("str", "source", "resource", "cwd", "strref"), last["value"]).otherwise("").alias("comm"),
        F.when(is_("execve execveat sched_process_exit"), value(0)).otherwise("").alias("exe_path"),
        scalars.ret_code(F.col("retval")).alias("ret_code"),
        F.filter(F.array(*plain, *extra), lambda a: a.isNotNull()).alias("named"),
    )


def _by_argument(table: dict[str, tuple]) -> dict[str, dict[int, list[str]]]:
    """Argument name -> place -> calls."""
    out: dict[str, dict[int, list[str]]] = {}
    for call, (_, _, _, arguments) in table.items():
        for a in arguments.split():
            key, place = a.split(":")
            out.setdefault(key, {}).setdefault(int(place), []).append(call)
    return out
