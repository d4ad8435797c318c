"""Session and coalescing state over streams: the same steps as the batch forms, a key at a time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "pid long, epoch long, fd int, sid long, path string, kind string, confidence double, bytes_read long, bytes_written long, start_ns long, end_ns long, n_events long"


def _kind(s: dict) -> str:
    r, w = s["br"] > 0, s["bw"] > 0
    if r or w:
        return "FileReadWrite" if r and w else "FileRead" if r else "FileWrite"
    return {"openr": "FileRead", "openw": "FileWrite", "openrw": "FileReadWrite"}.get(s["hint"], "FileAccess")


def _emit(pid: int, epoch: int, fd: str, s: dict, end: int, closed: bool) -> tuple | None:
    if closed and s["n"] == 1 and s["path"] is None:
        return None
    return (pid, epoch, int(fd), s["sid"], s["path"] or "", _kind(s), 1.0 if closed else 0.7, s["br"], s["bw"], s["start"], end, s["n"])


def step(state: dict, pid: int, op: str, fd: int, ts: int, path: str | None, hint: str | None, size: int, idle_ns: int) -> list[tuple]:
    """One event of a process; `state` holds its epoch, its open sessions and each fd's last number."""
    out: list[tuple | None] = []
    if op == "exit":
        for key, s in state["open"].items():
            out.append(_emit(pid, state["epoch"], key, s, ts if ts - s["last"] < idle_ns else s["last"], False))
        state.update(epoch=state["epoch"] + 1, open={}, sids={})
    elif op in ("open", "read", "write", "close"):
        key = str(fd)
        s = state["open"].get(key)
        if s and (op == "open" or ts - s["last"] >= idle_ns):
            out.append(_emit(pid, state["epoch"], key, state["open"].pop(key), s["last"], False))
            s = None
        if s is None:
            sid = state["sids"][key] = state["sids"].get(key, 0) + 1
            s = state["open"][key] = {"sid": sid, "path": None, "hint": "", "br": 0, "bw": 0, "start": ts, "last": ts, "n": 0}
        s["n"] += 1
        s["last"] = ts
        if op == "open":
            s["path"], s["hint"] = path, hint or ""
        elif op == "read":
            s["br"] += size
        elif op == "write":
            s["bw"] += size
        else:
            out.append(_emit(pid, state["epoch"], key, state["open"].pop(key), ts, True))
    return [x for x in out if x]


def _columns() -> list[str]:
    return [c.split()[0] for c in SESSION.split(", ")]


def file_sessions(events: DataFrame, idle_ns: int, delay: str = "0 seconds") -> DataFrame:
    """File sessions of a stream of canonical rows, keyed by process so that an exit ends all its files.

    Idle processes are emitted by event-time timers once the watermark has passed.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {"epoch": 0, "open": {}, "sids": {}}
        (pid,) = key
        out: list[tuple] = []
        if held.hasTimedOut:
            for fd, s in state["open"].items():
                out.append(_emit(pid, state["epoch"], fd, s, s["last"], False))
            state["open"] = {}
            held.update((json.dumps(state),))
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            for r in rows.itertuples(index=False):
                out += step(state, pid, r.op, int(r.fd), int(r.ts_ns), r.path, r.hint, int(r.bytes), idle_ns)
            held.update((json.dumps(state),))
            due = max([int(r) for r in rows["ts_ns"]] + [s["last"] for s in state["open"].values()]) + idle_ns
            held.setTimeoutTimestamp(max(due // 1_000_000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([x for x in out if x], columns=_columns())

    timed = events.withColumn("at", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("at", delay)
    return timed.groupBy("pid").applyInPandasWithState(run, SESSION, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def coalesced(events: DataFrame, window_ns: int) -> DataFrame:
    """Anchored windows over a stream, keyed by process: the state is the open window's start, count and bytes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        start, n, size = held.get if held.exists else (None, 0, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts_ns", "seq"]).itertuples(index=False):
            if start is not None and r.ts_ns - start <= window_ns:
                n, size = n + 1, size + r.bytes
                continue
            out.append((key[0], r.seq, r.ts_ns, n if n > 1 else 0, size if n > 1 else 0))
            start, n, size = r.ts_ns, 1, r.bytes
        held.update((int(start), int(n), int(size)))
        yield pd.DataFrame(out, columns=["pid", "seq", "ts_ns", "prev_count", "prev_bytes"])

    return events.groupBy("pid").applyInPandasWithState(run, "pid long, seq long, ts_ns long, prev_count long, prev_bytes long", "start long, n long, size long", "append", GroupStateTimeout.NoTimeout)
