"""Quality rules from cross-document line frequency, in DataFrame operations only.

Lines are normalised (lower case, digits to 0, white space to one blank) and
hashed, and for each host the distinct documents that hold a line are counted.
A line that more than `most_docs` documents of its host hold is removed from all
of the host's texts, however large the host; a document that keeps less than
`keep_share` of its words is depleted and rejected.

Rows with equal texts are one document, so that a group of copies does not make
its own lines frequent; with `copies` every row is a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, place_in, stored, text_of

MOST_DOCS = 25
KEEP_SHARE = 0.3

#: Words that windows of three found twice or more cover: sort the window hashes with their places; a place counts when a neighbour in that order has its hash.
_REPEATED = """
    aggregate(
        array_sort(filter(transform(sorted, (s, k) -> CASE
            WHEN (k > 0 AND sorted[k - 1].h = s.h) OR (k + 1 < size(sorted) AND sorted[k + 1].h = s.h) THEN s.i END), x -> x IS NOT NULL)),
        named_struct('sum', 0L, 'next', 0),
        (acc, i) -> named_struct('sum', acc.sum + (i + 3 - greatest(acc.next, i)), 'next', i + 3),
        acc -> acc.sum)
"""


#: The measures that the cleaned rows carry besides the columns of the documents.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_words", "kept")


def _measured(docs: DataFrame, host: str, carry: list[str]) -> DataFrame:
    rows = docs.select(F.struct(*carry).alias("own"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_of().alias("text"))
    rows = rows.select(
        "own", "host", F.xxhash64("text").alias("content"), F.expr(r"split(text, '\n')").alias("parts"),
        F.expr(rf"filter(split(text, r'{GAP}'), w -> w <> '')").alias("words"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')").alias("lines"),
        F.expr("bigint(regexp_count(text, r'[#*$%&|<>]'))").alias("n_symbols"),
    )
    rows = rows.select(
        "*",
        F.expr("CASE WHEN size(words) > 2 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE array() END").alias("grams"),
    )
    rows = rows.select(
        "own", "host", "content", "n_symbols", "parts", "lines",
        F.expr("bigint(size(words))").alias("n_words"),
        F.expr("bigint(length(array_join(words, '')))").alias("word_chars"),
        F.expr("bigint(size(lines) - size(array_distinct(lines)))").alias("n_dup_lines"),
        F.expr("CASE WHEN size(array_distinct(grams)) < size(grams) THEN sort_array(transform(grams, (h, i) -> named_struct('h', h, 'i', i))) END").alias("sorted"),
    )
    clean = rf"trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0'), r'{GAP}', ' '))"
    return rows.select(
        "own", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr(f"CASE WHEN sorted IS NULL THEN 0L ELSE {_REPEATED} END").alias("n_repeat_words"),
        "parts",
        F.expr(f"transform(parts, l -> CASE WHEN l rlike r'[^\\x20\\x09-\\x0D]' THEN xxhash64({clean}) END)").alias("hashes"),
        F.expr(rf"transform(parts, l -> regexp_count(l, r'{WORD}'))").alias("counts"),
    )


def cleaned(docs: DataFrame, host: str = "source", most_docs: int = MOST_DOCS, keep_share: float = KEEP_SHARE, copies: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: its columns (or those of `carry`), `text` without the frequent lines of its host, and the measures.

    A null text is empty (no words: base_failed); a null host is the host "".
    Repeated rows are judged alike.  Two windows are taken as equal when their
    64-bit hashes are; likewise lines.  Lines end at a line feed, which goes with
    its line; blank lines stay.  The measures but n_frequent_words and kept are
    those of the text as it came in.  Columns of `docs` that are named like a
    measure are left out.
    """
    carry = [c for c in carry or docs.columns if c not in ("text", *MEASURES)]
    rows = stored(_measured(docs, host, carry), "lines")
    held = rows.select("host", "content", F.explode(F.expr("array_distinct(filter(hashes, h -> h IS NOT NULL))")).alias("hash"))
    counted = held if copies else held.distinct()
    # Stored, so that its size is known before the lines are dealt out for the join.
    frequent = stored(counted.groupBy("host", "hash").agg(F.count("*").alias("docs")).where(F.col("docs") > most_docs).select("host", "hash"), "frequent")
    gone = held.join(frequent, ["host", "hash"]).groupBy("host", "content").agg(F.sort_array(F.collect_set("hash")).alias("gone"))  # a text's own lines
    out = rows.join(stored(gone, "gone"), ["host", "content"], "left")
    # Lines, hashes and counts are columns of their own, so that what needs no text does not take it through the join.
    stays = f"hashes[i] IS NULL OR {place_in('gone', 'hashes[i]')} = 0"
    out = out.withColumn("text", F.expr(f"array_join(CASE WHEN gone IS NOT NULL THEN filter(parts, (l, i) -> {stays}) ELSE parts END, '\n')"))
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    lost = F.expr(f"CASE WHEN gone IS NOT NULL THEN aggregate(filter(counts, (n, i) -> NOT ({stays})), 0L, (a, n) -> a + n) ELSE 0L END")
    return out.withColumn("n_frequent_words", lost).select(
        "own.*", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_frequent_words",
        (~failed & (F.col("n_words") - F.col("n_frequent_words") >= F.lit(keep_share) * F.col("n_words"))).alias("kept"),
    )


def line_rules(docs: DataFrame, host: str = "source", most_docs: int = MOST_DOCS, keep_share: float = KEEP_SHARE, copies: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id and the measures of cleaned()."""
    return cleaned(docs, host, most_docs, keep_share, copies, carry=["doc_id"]).select("doc_id", *MEASURES)
