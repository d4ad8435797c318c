"""Binary frames: a 72-byte little-endian header and tagged arguments, or a 16-byte compact header.

Decoding runs in an Arrow UDF over (seq, raw); what needs the order of frames
(the compact header's base, the per-CPU counters) is done in the plan.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Layouts, event types and argument tags of the wire format.
HEADER = struct.Struct("<bbHIQIIQiiiiiiIIii")
HEADER_FIELDS = ("event_type", "arg_num", "cpu", "event_id", "ts", "pid_ns", "mnt_ns", "cgroup_id", "host_ppid", "ppid", "host_pid", "host_tid", "pid", "tid", "uid", "gid", "syscall_id", "retval")
COMPACT = struct.Struct("<bbHIii")
COMPACT_TYPE = 0x13
UNARY_TYPE = 2
MAX_STRING = 2048
INT, UINT, ULONG, STR, STR_ARRAY, SOURCE, RESOURCE, CWD, STR_REF, COUNT, BYTES, VAR32, VAR64, CPU_SEQ = range(1, 15)
_NAMES = {INT: "int", UINT: "uint", ULONG: "ulong", STR: "str", STR_ARRAY: "strarr", SOURCE: "source", RESOURCE: "resource", CWD: "cwd", STR_REF: "strref", COUNT: "count", BYTES: "bytes", VAR32: "uint", VAR64: "ulong"}

FRAME = (
    "seq long, compact boolean, " + ", ".join(f"{f} {'long' if f in ('event_id', 'ts', 'pid_ns', 'mnt_ns', 'cgroup_id', 'uid', 'gid') else 'int'}" for f in HEADER_FIELDS)
    + ", args array<struct<type:string,value:string,parts:array<string>>>, cpu_seq long, error string"
)


def encode_varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def decode_varint(raw: bytes, at: int, most: int) -> tuple[int, int]:
    """(value, place behind it); at most `most` bytes."""
    value = 0
    for k in range(most):
        if at + k >= len(raw):
            raise ValueError("frame ends in a varint")
        byte = raw[at + k]
        value |= (byte & 0x7F) << (7 * k)
        if byte < 0x80:
            return value, at + k + 1
    raise ValueError("varint too long")


class _Reader:
    def __init__(self, raw: bytes, at: int):
        self.raw, self.at = raw, at

    def take(self, form: str):
        size = struct.calcsize(form)
        if self.at + size > len(self.raw):
            raise ValueError("frame ends in an argument")
        (value,) = struct.unpack_from(form, self.raw, self.at)
        self.at += size
        return value

    def text(self) -> str:
        n = self.take("<I")
        if n > MAX_STRING:
            raise ValueError("string too long")
        if self.at + n > len(self.raw):
            raise ValueError("frame ends in a string")
        self.at += n
        return self.raw[self.at - n : self.at].rstrip(b"\0").decode("utf-8", "replace")

    def argument(self) -> tuple[int, str, list[str] | None]:
        tag = self.take("<I")
        if tag in (INT, UINT, ULONG, COUNT, BYTES, STR_REF):
            return tag, str(self.take({INT: "<i", UINT: "<I", COUNT: "<I"}.get(tag, "<Q"))), None
        if tag in (STR, SOURCE, RESOURCE, CWD):
            return tag, self.text(), None
        if tag == STR_ARRAY:
            parts = []
            while self.take("<I"):
                parts.append(self.text())
            return tag, "", parts
        if tag in (VAR32, VAR64, CPU_SEQ):
            value, self.at = decode_varint(self.raw, self.at, 5 if tag == VAR32 else 10)
            return tag, str(value & 0xFFFFFFFF if tag == VAR32 else value), None
        raise ValueError(f"unknown argument tag {tag:#x}")


def decode(raw: bytes) -> dict:
    """A frame's fields; an argument that can't be read ends the list and is told in `error`."""
    out: dict = {"compact": False, "args": [], "cpu_seq": None, "error": None}
    if len(raw) and raw[0] == COMPACT_TYPE:
        if len(raw) < COMPACT.size:
            return out | {"error": "short header"}
        values = dict(zip(("event_type", "arg_num", "cpu", "ts", "syscall_id", "retval"), COMPACT.unpack_from(raw)))
        out |= values | {"compact": True}
        reader = _Reader(raw, COMPACT.size)
    else:
        if len(raw) < HEADER.size:
            return out | {"error": "short header"}
        out |= dict(zip(HEADER_FIELDS, HEADER.unpack_from(raw)))
        out["cgroup_id"] = out["cgroup_id"] - (1 << 64) if out["cgroup_id"] >= 1 << 63 else out["cgroup_id"]
        reader = _Reader(raw, HEADER.size)
    try:
        for _ in range(out["arg_num"]):
            tag, value, parts = reader.argument()
            if tag == CPU_SEQ:
                out["cpu_seq"] = int(value)
            else:
                out["args"].append({"type": _NAMES[tag], "value": value, "parts": parts})
    except ValueError as e:
        out["error"] = str(e)
    return out


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ("seq, compact, " + ", ".join(HEADER_FIELDS) + ", args, cpu_seq, error").split(", ")]
    for pdf in batches:
        rows = [{"seq": seq, **decode(bytes(raw or b""))} for seq, raw in zip(pdf["seq"], pdf["raw"])]
        yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in (*HEADER_FIELDS, "cpu_seq")})


def decode_frames(frames: DataFrame) -> DataFrame:
    """(seq, raw) to one row a frame; a row whose header is short has only `error`."""
    return frames.select("seq", "raw").mapInPandas(_decoded, FRAME)


def expand_compact(decoded: DataFrame) -> DataFrame:
    """Compact frames with the fields of their CPU's last full frame, and time as that frame's plus all deltas since.

    Compact frames before any full one of their CPU are orphans: `error` says so.
    """
    order = Window.partitionBy("cpu").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = decoded.where("cpu IS NOT NULL").withColumn("base_no", F.sum(F.expr("int(NOT compact)")).over(order))
    since = Window.partitionBy("cpu", "base_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inherited = [f for f in HEADER_FIELDS if f not in ("event_type", "arg_num", "cpu", "ts", "syscall_id", "retval")]
    full = rows.select(
        "seq", "compact", "cpu", "arg_num", "syscall_id", "retval", "args", "cpu_seq",
        F.when(F.col("compact"), F.lit(UNARY_TYPE)).otherwise(F.col("event_type")).alias("event_type"),
        F.sum("ts").over(since).alias("ts"),
        *(F.first(f, ignorenulls=True).over(since).alias(f) for f in inherited),
        F.when(F.col("base_no") == 0, "compact frame before its base").otherwise(F.col("error")).alias("error"),
    )
    return full


def sequence_gaps(rows: DataFrame, cpu: str = "cpu", number: str = "cpu_seq") -> DataFrame:
    """Lost records a CPU: what its counter leaps over; a first sighting and a reset add nothing."""
    prev = F.lag(number).over(Window.partitionBy(cpu).orderBy("seq"))
    return rows.where(F.col(number).isNotNull()).select(cpu, F.greatest(F.coalesce(F.col(number) - prev - 1, F.lit(0)), F.lit(0)).alias("gap")).groupBy(cpu).agg(F.sum("gap").alias("lost"))


def resolve_refs(args: DataFrame, dictionary: DataFrame, hash_col: str = "hash") -> DataFrame:
    """String references by a dictionary (hash, text); a miss is empty and flagged."""
    return args.join(dictionary, hash_col, "left").withColumn("missed", F.col("text").isNull()).withColumn("text", F.coalesce("text", F.lit("")))
