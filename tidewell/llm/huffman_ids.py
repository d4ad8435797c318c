"""Token-id files in canonical length-limited Huffman code.

The file format is a table of blocks: whole documents in ascending doc_id order,
their ids coded most significant bit first, with the bit offset of every
`stride`-th id as an entry point.  Blocks are independent; all a reader needs
besides is the code's lengths (symbol, length), from which the canonical code
follows.  Decoding looks up `max_bits` bits at a time, for all entry points of
many blocks in step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of
from .token_ids import encoder, vocabulary

END_ID = 2
MAX_BITS = 18
STRIDE = 256
BLOCK_IDS = 16384
_BLOCK = "part int, before long, doc_ids array<long>, counts array<int>, entries array<long>, payload binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `max_bits` for the symbols with a count, 0 for the others (package-merge)."""
    out = np.zeros(len(counts), dtype=np.int64)
    symbols = np.flatnonzero(counts)
    n = len(symbols)
    if n == 0:
        return out
    if n == 1:
        out[symbols] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError("more symbols than codes of that length")
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[symbols].astype(np.int64)
    row, flags = leaves, [np.ones(n, dtype=bool)]
    for _ in range(max_bits - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        row = both[order]
        flags.append(order < n)
    take = 2 * n - 2
    for leaf in reversed(flags):
        chosen = leaf[:take]
        k = int(chosen.sum())
        out[symbols[:k]] += 1
        take = 2 * (len(chosen) - k)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code: shorter codes first, then by symbol."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, last = 0, 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[symbol] == 0:
            continue
        code <<= int(lengths[symbol]) - last
        last = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For each string of `max_bits` bits: symbol << 5 | length of the code it starts with."""
    table = np.zeros(1 << max_bits, dtype=np.uint32)
    codes = canonical(lengths)
    for symbol in np.flatnonzero(lengths):
        free = max_bits - int(lengths[symbol])
        first = int(codes[symbol]) << free
        table[first : first + (1 << free)] = symbol << 5 | int(lengths[symbol])
    return table


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """The ids' bits, and the bit offsets of every `stride`-th id."""
    size, code = lengths[ids], codes[ids]
    ends = np.cumsum(size)
    starts = ends - size
    word, off = starts >> 6, starts & 63
    room = 64 - off - size
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    words = np.zeros(int(ends[-1] >> 6) + 2, dtype=np.uint64)
    groups = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[groups]] = np.add.reduceat(high, groups)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], starts[::stride]


def decode_blocks(payloads: list[bytes], entries: list[np.ndarray], totals: list[int], table: np.ndarray, stride: int = STRIDE, max_bits: int = MAX_BITS) -> list[np.ndarray]:
    """The ids of each block, all entry points of all blocks in step."""
    joined = np.frombuffer(b"".join(payloads) + bytes(4 * stride + 8), dtype=np.uint8).astype(np.uint32)
    window = joined[:-3] << 24 | joined[1:-2] << 16 | joined[2:-1] << 8 | joined[3:]
    begin = np.cumsum([0, *(8 * len(p) for p in payloads)])[:-1]
    at = np.concatenate([e + b for e, b in zip(entries, begin)]).astype(np.int64)
    out = np.empty((stride, len(at)), dtype=np.uint16)
    limit, shift, mask = 8 * (len(window) - 1), 32 - max_bits, np.uint32((1 << max_bits) - 1)
    for k in range(stride):
        found = table[(window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(shift) & mask]
        out[k] = found >> np.uint32(5)
        at += found & np.uint32(31)
        np.minimum(at, limit, out=at)  # lanes that are through read on in the padding
    lanes, found, lane = out.T, [], 0
    for e, n in zip(entries, totals):
        found.append(np.ascontiguousarray(lanes[lane : lane + len(e)]).reshape(-1)[:n])
        lane += len(e)
    return found


def _tokens(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, place = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            found = code.encode(batch.column(1))
            for k in range(0, batch.num_rows, 512):
                doc_ids = batch.column(0).slice(k, 512)
                ids = [raw + end for raw in islice(found, 512)]
                ends = np.cumsum([len(raw) // 2 for raw in ids]) + place
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(np.concatenate([[place], ends[:-1]]).astype(np.int64)), doc_ids, pa.array(ids, pa.binary())],
                    names=["part", "place", "doc_id", "ids"],
                )
                place = int(ends[-1])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(65536, dtype=np.int64)
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(k, 512).to_pylist()), dtype="<u2"), minlength=65536)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["symbol", "n"])


def _encoded(lengths: np.ndarray, block_ids: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        held: list[tuple] = []
        part = before = size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(r[1] for r in held), dtype="<u2")
            payload, entries = encode_block(ids, codes, lengths, stride)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([before], pa.int64()),
                    pa.array([[r[0] for r in held]], pa.list_(pa.int64())), pa.array([[len(r[1]) // 2 for r in held]], pa.list_(pa.int32())),
                    pa.array([entries], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
                ],
                names=["part", "before", "doc_ids", "counts", "entries", "payload"],
            )

        # A block holds documents that follow each other in their part, however the reader has split the parts.
        for batch in batches:
            for p, place, doc_id, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (p != part or place != before + size or size >= block_ids):
                    yield flush()
                    held, size = [], 0
                if not held:
                    part, before = p, place
                held.append((doc_id, ids))
                size += len(ids) // 2
        if held:
            yield flush()

    return run


def _decoded(lengths: np.ndarray, stride: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, before, doc_ids, counts, entries, payload = (batch.column(c).slice(k, 64).to_pylist() for c in range(6))
                blocks = decode_blocks(payload, [np.array(e, dtype=np.int64) for e in entries], [sum(c) for c in counts], table, stride)
                rows = []
                for p, b, names, sizes, ids in zip(part, before, doc_ids, counts, blocks):
                    at = 0
                    for name, n in zip(names, sizes):
                        own = ids[at : at + n]
                        rows.append((name, p, b + at, n, zlib.crc32(own.astype("<u4").tobytes())) + ((own.tobytes(),) if with_ids else ()))
                        at += n
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "part", "place", "n_tokens", "ids_crc32", "ids"][: 5 + with_ids])

    return run


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID, max_bits: int = MAX_BITS, stride: int = STRIDE, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """Write the files: (blocks, code lengths), both as tables of the shared folder.

    Documents stand in ascending order of doc_id (nulls first, ties by text).  A
    null text is empty and consists of its end id; an empty table has no blocks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sorted_ = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ids = stored(sorted_.mapInArrow(_tokens(path or vocabulary(), end_id), "part int, place long, doc_id long, ids binary"), "ids")
    counts = np.zeros(65536, dtype=np.int64)
    for r in ids.select("ids").mapInArrow(_counted, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():  # at most one row a symbol
        counts[r["symbol"]] = r["n"]
    lengths = code_lengths(counts, max_bits)
    spark = docs.sparkSession
    code = stored(spark.createDataFrame([(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)], "symbol int, length int").coalesce(1), "code")
    blocks = stored(ids.select("part", "place", "doc_id", "ids").mapInArrow(_encoded(lengths, block_ids, stride), _BLOCK), "blocks")
    return blocks, code


def read_ids(blocks: DataFrame, code: DataFrame, stride: int = STRIDE, with_ids: bool = True) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32 and the ids (unsigned 16-bit, little-endian)."""
    lengths = np.zeros(65536, dtype=np.int64)
    for r in code.collect():  # at most one row a symbol
        lengths[r["symbol"]] = r["length"]
    kinds = "doc_id long, part int, place long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = blocks.select("part", "before", "doc_ids", "counts", "entries", "payload").mapInArrow(_decoded(lengths, stride, with_ids), kinds)
    sizes = blocks.select("part", (F.col("before") + F.expr("aggregate(counts, 0L, (a, c) -> a + c)")).alias("upto")).groupBy("part").agg(F.max("upto").alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row a file
    out = rows.join(base, "part")
    return out.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
