"""Secret scans: patterns, and guess cost of values that stand in a credential's context.

A value's guess cost (bits) is that of its cheapest segmentation, by dynamic
programming over its ends, into

* words: a short list of common passwords and the `vocabulary` commonest words of
  the corpus, by their rank; letters may be capital or written as digits;
* years and dates;
* one character several times, and repeats of what stands before: the next
  characters are those `p` places back, where their first three stood last;
* straight walks over neighbouring keys, or along the alphabet;
* brute-force spans.

Values that cost `least_bits` or more are reported.  Words are counted by
document over the whole corpus, but not inside such values: a secret that is in
many documents does not become a word.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import inf, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LEAST_BITS = 40.0
#: Ranks of the corpus's words that are known: the dictionary that tasks get, of words of 3 to LONGEST letters.
VOCABULARY = 20_000
LONGEST = 32
KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization|auth|bearer)["']?(?:\x20*[:=]\x20*|(\x20+is\x20+))(?:bearer\x20+)?["']?([^\s"',;<>]+)""",
    re.ASCII | re.IGNORECASE,
)
#: What follows "is" as in a sentence: words, hyphens between them, no digits or capitals inside.
_PROSE = re.compile(r"[^\W\d_][^\W\d_A-Z]*(?:[-'’/][^\W\d_][^\W\d_A-Z]*)*")
_CUES = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")

# Common password words, most common first, and keyboard rows.
WORDS = """password 123456 admin qwerty letmein welcome monkey dragon master login sunshine princess football shadow superman
 michael baseball trustno hello freedom whatever ninja mustang access flower secret test user guest root default changeme
 passwort contraseña contrasena motdepasse hallo hola bonjour geheim sonnenschein schatz soleil azerty qwertz 1qaz2wsx qazwsx zaq12wsx 1q2w3e4r
 iloveyou tequiero jetaime abc123 passw0rd token key demo example sample private public server system database backup service client account
 summer winter spring autumn sommer verano love money hunter batman starwars cheese coffee orange purple silver golden london paris berlin madrid
 america computer internet correct horse battery staple pass word your the and for not with this that from have none null true false here value string abc""".split()
KEYS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"

_RANK = {w: k + 1 for k, w in reversed(list(enumerate(WORDS)))}
_PLAIN = str.maketrans("013457@$", "oleastas")
_YEAR = re.compile(r"(?:19|20)\d\d")
_MONTH, _DAY = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Dates by length: with four-digit years 8 characters, or 10 with separators, with two-digit years 6 or 8; and their guesses.
_DATES = [
    (8, 200 * 372, re.compile(rf"(?:19|20)\d\d{_MONTH}{_DAY}|{_DAY}{_MONTH}(?:19|20)\d\d|{_MONTH}{_DAY}(?:19|20)\d\d")),
    (10, 400 * 372, re.compile(rf"(?:19|20)\d\d([-/.]){_MONTH}\1{_DAY}|{_DAY}([-/.]){_MONTH}\2(?:19|20)\d\d|{_MONTH}([-/.]){_DAY}\3(?:19|20)\d\d")),
    (6, 100 * 372, re.compile(rf"\d\d{_MONTH}{_DAY}|{_DAY}{_MONTH}\d\d|{_MONTH}{_DAY}\d\d")),
    (8, 200 * 372, re.compile(rf"\d\d([-/.]){_MONTH}\1{_DAY}|{_DAY}([-/.]){_MONTH}\2\d\d|{_MONTH}([-/.]){_DAY}\3\d\d")),
]
#: Guesses for a walk's first key and direction: along a row or the alphabet, or across the rows.
ALONG, ACROSS = 92, 376


def _steps() -> dict[str, tuple[tuple[int, int], ...]]:
    """The directions in which two keys follow each other; a key's lower neighbours stand at its place and one before."""
    at = {c: (r, k) for r, row in enumerate(KEYS) for k, c in enumerate(row)}
    out: dict[str, list[tuple[int, int]]] = {}
    for a, (r, k) in at.items():
        for b, (r2, k2) in at.items():
            if (r2 - r, k2 - k) in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)):
                out.setdefault(a + b, []).append((r2 - r, k2 - k))
    for a, b in zip(ALPHABET, ALPHABET[1:]):
        out.setdefault(a + b, []).append((0, 2))
        out.setdefault(b + a, []).append((0, -2))
    return {pair: tuple(found) for pair, found in out.items()}


_STEPS = _steps()
_WALK = {(r, k): log2(ALONG if r == 0 else ACROSS) for r in (-1, 0, 1) for k in (-2, -1, 0, 1, 2)}


def _brute(c: str) -> float:
    return log2(10) if c.isdigit() else log2(26) if c.isalpha() else log2(33)


class _Run:
    """The least of cost + log2(length) over the starts of a run that grows by a character at a time.

    An earlier start that costs no more than a later one now never will again,
    as its length grows by a smaller factor; the others are kept.
    """

    def __init__(self) -> None:
        self.starts: list[tuple[float, int]] = []

    def least(self, end: int) -> float:
        kept: list[tuple[float, int]] = []
        least = inf
        for cost, start in self.starts:
            now = cost + log2(end - start)
            if now < least:
                while kept and kept[-1][0] >= cost:
                    kept.pop()
                kept.append((cost, start))
                least = now
        self.starts = kept
        return least


def guess_bits(value: str, ranks: dict[str, int] = _RANK) -> float:
    """Bits of the cheapest segmentation; every piece costs one bit besides its own."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose small form is two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_PLAIN)
    best = [0.0] + [inf] * n
    brute = inf  # the last character is brute force
    same, walks, copies, last = _Run(), {}, {}, {}
    for j in range(1, n + 1):
        c = value[j - 1]
        brute = _brute(c) + min(brute, best[j - 1] + 1)
        cost, i = brute, j - 3
        if j > 1 and value[j - 2] != c:
            same = _Run()
        if j > 1:
            walks = {way: walks.get(way) or (j - 2, _Run()) for way in _STEPS.get(low[j - 2 : j], ())}
        copies = {p: run for p, run in copies.items() if value[j - 1] == value[j - 1 - p]}
        if i >= 0:
            three = value[i:j]
            if c == three[0] == three[1]:
                same.starts.append((best[i] + 1 + _brute(c), i))
            for way, (first, run) in walks.items():
                if first <= i:
                    run.starts.append((best[i] + 1 + _WALK[way], i))
            if three in last:
                p = i - last[three]
                copies.setdefault(p, _Run()).starts.append((best[i] + 1 + log2(p), i))
            last[three] = i
            cost = min(cost, same.least(j), *(run.least(j) for _, run in walks.values()), *(run.least(j) for run in copies.values()))
        for a in range(max(0, j - LONGEST), j - 2):
            rank, odd = ranks.get(low[a:j]), 0
            if rank is None:
                rank, odd = ranks.get(plain[a:j]), 2
            if rank:
                upper = sum(x.isupper() for x in value[a:j])
                cost = min(cost, best[a] + 1 + log2(rank) + odd + (upper > 0) + (1 < upper < j - a) * log2(j - a))
        if c.isdigit():
            if j >= 4 and _YEAR.fullmatch(value, j - 4, j):
                cost = min(cost, best[j - 4] + 1 + log2(200))
            for size, guesses, pattern in _DATES:
                if j >= size and pattern.fullmatch(value, j - size, j):
                    cost = min(cost, best[j - size] + 1 + log2(guesses))
        best[j] = cost
    return best[n]


def values(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(spans of assignments, spans of the values whose cost counts), both in order."""
    low = text.lower()
    if not any(cue in low for cue in _CUES):
        return [], []
    assigned = [m for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found = {m.span(2) for m in assigned}
    for m in _CONTEXT.finditer(text):
        a, b = m.span(2)
        if m[1]:
            b = a + len(m[2].rstrip(".!?:)"))
            if _PROSE.fullmatch(text, a, b):
                continue
        if b - a >= 6:
            found.add((a, b))
    return [m.span() for m in assigned], sorted(found)


def scan(text: str, least_bits: float = LEAST_BITS, ranks: dict[str, int] = _RANK) -> tuple[list[tuple[int, int, int]], float]:
    """(start, kind's number, end) of all spans in order, and the highest guess cost of a context's value."""
    assigned, worth = values(text)
    found = [(a, 0, b) for a, b in assigned]
    most = 0.0
    for a, b in worth:
        bits = guess_bits(text[a:b], ranks)
        most = max(most, bits)
        if bits >= least_bits:
            found.append((a, 3, b))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found), most


#: Different words that a task counts before it hands them on.
_HELD = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """The different words of a text, outside the values of credentials."""
    parts, at = [], 0
    for a, b in values(text)[1]:
        parts.append(text[at:a])
        at = max(at, b)
    return {w for part in [*parts, text[at:]] for w in _LETTERS.findall(part.lower()) if 3 <= len(w) <= LONGEST}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for text in batch.column(0).slice(at, 256).to_pylist():
                counts.update(words_of(text))
            if len(counts) > _HELD:
                yield out()
                counts.clear()
    yield out()


def word_ranks(docs: DataFrame, vocabulary: int = VOCABULARY) -> dict[str, int]:
    """Rank by word: the fixed list, and behind it the `vocabulary` words that most documents hold (ties by the word)."""
    rows = docs.select(text_of().alias("text")).mapInArrow(_counted, "word string, n long")
    common = rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(vocabulary).select("word")
    ranks = {r["word"]: len(WORDS) + k + 1 for k, r in enumerate(common.collect())}  # `vocabulary` words at most
    return ranks | _RANK


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scanned(least_bits: float, ranks: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for text in batch.column(1).slice(at, 512).to_pylist():
                    spans, bits = scan(text, least_bits, ranks)
                    base = [s for s in spans if s[1] < 3]
                    n = [sum(s[1] == k for s in base) for k in range(3)]
                    rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), bits))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 512), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "most_bits"],
                )

    return run


def find_secrets(docs: DataFrame, least_bits: float = LEAST_BITS, vocabulary: int = VOCABULARY) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, most_bits.

    Null and empty texts have no spans.  Places are code points, ends exclusive.
    Guess spans hold the value alone and stand beside the pattern's own span.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ranks = word_ranks(docs, vocabulary)
    return rows.mapInArrow(_scanned(least_bits, ranks), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, most_bits double")
