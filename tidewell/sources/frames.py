"""Wire frames made of canonical rows, for replays and tests."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import wire


def string_arg(tag: int, text: str) -> bytes:
    raw = text.encode()
    return struct.pack("<II", tag, len(raw)) + raw


def full_frame(args: list[bytes], **fields: int) -> bytes:
    values = dict.fromkeys(wire.HEADER_FIELDS, 0) | {"event_type": wire.UNARY_TYPE, "arg_num": len(args)} | fields
    return wire.HEADER.pack(*(values[f] for f in wire.HEADER_FIELDS)) + b"".join(args)


def compact_frame(args: list[bytes], cpu: int, delta_ns: int, syscall_id: int, retval: int) -> bytes:
    return wire.COMPACT.pack(wire.COMPACT_TYPE, len(args), cpu, delta_ns, syscall_id, retval) + b"".join(args)


def _built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        raw = []
        for r in pdf.itertuples(index=False):
            seq_arg = struct.pack("<I", wire.CPU_SEQ) + wire.encode_varint(r.seq)
            if r.k % 3:
                raw.append(full_frame([string_arg(wire.RESOURCE, r.peer), seq_arg], cpu=r.pid % 4, ts=r.ts_ns, pid=r.pid, host_tid=r.pid, syscall_id=r.k, retval=r.k - 5, event_id=r.seq))
            else:
                raw.append(compact_frame([struct.pack("<I", wire.VAR64) + wire.encode_varint(r.bytes), seq_arg], r.pid % 4, 1000, r.k, r.k - 5))
        yield pd.DataFrame({"seq": pdf["seq"], "raw": raw})


def frames_of(rows: DataFrame) -> DataFrame:
    """(seq, raw): every third row as a compact frame."""
    return rows.select("seq", "ts_ns", "pid", "k", "peer", "bytes").mapInPandas(_built, "seq long, raw binary")
