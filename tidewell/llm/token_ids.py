"""Token ids of whole texts from a tokenizers vocabulary file, with a bounded cache of text units.

A byte-level pre-tokeniser never joins what stands before a space to the word
behind it, and never a letter or digit to the punctuation that follows.  So the
texts of a batch are cut there, equal units are found together by Arrow, each
that is new is encoded once by the library and kept, and the ids of a text are
those of its units in order.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES

#: Units in each of the two generations of a worker's cache: when the younger one is full the older one goes.
CACHE_UNITS = 700_000
#: Bytes of units at which a generation is full too.
CACHE_BYTES = 20_000_000
#: Bytes of texts that are cut at once; a longer text is by itself.
TOGETHER = 8_000_000


#: Bytes that are marked at once, so that the marks stay in the processor's cache.
_SEGMENT = 1 << 17


def _within(data: np.ndarray, first: int, last: int) -> np.ndarray:
    return data - np.uint8(first) <= np.uint8(last - first)


def _marks(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a unit starts at each byte of `data`, judged by at most two bytes before and one after it."""
    before, here = data[:-1], data[1:]
    ascii_ = data < np.uint8(0x80)
    letter, digit, graph = _within(data | np.uint8(0x20), 0x61, 0x7A), _within(data, 0x30, 0x39), _within(data, 0x21, 0x7E)
    # Surely no blank: visible ASCII, and first bytes that no blank has.
    visible = graph | _within(data, 0xC3, 0xDF) | _within(data, 0xE4, 0xF4)
    # The last byte of a letter: ASCII, Latin but for the signs of multiplication and division, Cyrillic.
    two = _within(data, 0xC3, 0xC5) | _within(data, 0xD0, 0xD1)
    last = letter.copy()
    last[1:] |= two[:-1] & ~((before == 0xC3) & ((here == 0x97) | (here == 0xB7)))
    cut = first.copy()
    cut[1:] |= (last[:-1] & ~letter[1:] | digit[:-1] & ~digit[1:]) & ascii_[1:]
    cut[:-1] |= (before == 0x20) & visible[1:] & ~first[1:]  # the next text's start says nothing of this one's last space
    cut[2:] |= (last | graph)[:-2] & (data[1:-1] == 0x0A) & visible[2:]
    return cut


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units start in the UTF-8 bytes of texts that start at `starts`, in order and without repeats.

    A unit starts before a space that something visible follows, behind a letter
    or digit that ends its run, behind a single line break between two words, and
    with each text.  Where characters are not surely of these kinds none does.
    """
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = True
    cut = np.empty(n, dtype=bool)
    for a in range(0, n, _SEGMENT):
        low, b = max(a - 2, 0), min(a + _SEGMENT, n)
        cut[a:b] = _marks(data[low : b + 1], first[low : min(b + 1, n)])[a - low : b - low]
    return np.flatnonzero(cut)


class UnitEncoder:
    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.break_id = self.library.encode("\n", add_special_tokens=False).ids
        self.cache_units = cache_units
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.bytes = 0

    def ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without places in the text

    def whole(self, text: str) -> bytes:
        return np.array(self.ids(text), dtype="<u2").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Encode units that are not kept yet: those without blanks but a space in front together, parted by line breaks.

        A line break between two of them is a token by itself.
        """
        self.bytes += sum(map(len, new))
        plain = []
        for raw in new:
            unit = raw.decode()
            words = unit.split()
            if len(self.break_id) == 1 and len(words) == 1 and (words[0] == unit or " " + words[0] == unit):
                plain.append((raw, unit))
            else:
                self.kept[raw] = self.whole(unit)
        for at in range(0, len(plain), 256):
            group = plain[at : at + 256]
            ids = np.array(self.ids("\n".join([unit for _, unit in group])), dtype="<u2")
            breaks = np.flatnonzero(ids == self.break_id[0])
            if len(breaks) != len(group) - 1:  # a unit's own ids hold the break's
                for raw, unit in group:
                    self.kept[raw] = self.whole(unit)
                continue
            found, ends = ids.tobytes(), (breaks * 2).tolist()
            for (raw, _), a, b in zip(group, chain([0], (e + 2 for e in ends)), chain(ends, [len(found)])):
                self.kept[raw] = found[a:b]

    def _ids_of(self, units: list[bytes]) -> list[bytes]:
        """The ids of different units."""
        if len(self.kept) > self.cache_units or self.bytes > CACHE_BYTES:
            self.older, self.kept, self.bytes = self.kept, {}, 0
        found = list(map(self.kept.get, units))
        holes = [k for k, f in enumerate(found) if f is None]
        new = []
        for k in holes:
            if (known := self.older.get(units[k])) is None:
                new.append(units[k])
            else:
                self.kept[units[k]] = known
                self.bytes += len(units[k])
        self._learn(new)
        for k in holes:
            found[k] = self.kept[units[k]]
        return found

    def _encode(self, texts: pa.Array) -> list[bytes]:
        starts = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        at, upto = int(starts[0]), int(starts[-1])
        if at == upto:
            return [b""] * len(texts)
        data = texts.buffers()[2].slice(at, upto - at)
        starts = starts - at
        units = np.append(cuts(np.frombuffer(data, dtype=np.uint8), starts), upto - at).astype(np.int32)
        different = pa.BinaryArray.from_buffers(pa.binary(), len(units) - 1, [None, pa.py_buffer(units), data]).dictionary_encode()
        known = self._ids_of(different.dictionary.to_numpy(zero_copy_only=False).tolist())
        taken = pa.array(known, pa.large_binary()).take(different.indices)
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[np.searchsorted(units, starts)].tolist()
        raw = memoryview(taken.buffers()[2] or b"")
        out = [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]
        for special in self.special:
            for k in np.flatnonzero(pc.match_substring(texts, special).to_numpy(zero_copy_only=False)).tolist():
                out[k] = self.whole(texts[k].as_py())
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text (null: none) as little-endian unsigned 16-bit integers."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        k = done = 0
        while k < len(texts):
            n = max(int(np.searchsorted(upto, done + TOGETHER, side="right")) - k, 1)
            yield from self._encode(texts.slice(k, n).cast(pa.string()))
            k, done = k + n, int(upto[k + n - 1])


@lru_cache(maxsize=4)
def encoder(path: str) -> UnitEncoder:
    """One encoder a worker process and vocabulary file."""
    return UnitEncoder(path)


CACHES.append(encoder.cache_clear)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
