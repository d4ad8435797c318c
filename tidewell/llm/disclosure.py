"""Personal data: patterns, and the terms around them that reveal them, in DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card and phone numbers; the
distinct strings are the protected entities.  Over the whole corpus, a term (a
word of letters that no base span overlaps) discloses an entity as far as their
pointwise mutual information reaches the entity's own information content:

    log(co * N / (n_entity * n_term))  /  log(N / n_entity)

with document counts; a pair counts in every document that holds both, however
far apart.  From `generalise_at` on the term is generalised, from `remove_at` on
it is removed, wherever it stands in any document, with the entity or without.
Pairs seen in fewer than `least_docs` documents say nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import place_in, stored, text_of

GENERALISE_AT = 0.8
REMOVE_AT = 0.95
LEAST_DOCS = 3
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")

#: Stands for a letter of a base span, only where words are sought; a text's own ones are no letters and become blanks there.
_P = "￿"
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _running(values: str, step: str) -> str:
    """SQL: the running sums (or other `step`s of x and y) of an array of ints, doubling the reach: n log n operations."""
    reach = "shiftleft(1, k)"
    joined = step.format(x="x", y=f"acc[i - {reach}]")
    return f"aggregate(sequence(0, 30), {values}, (acc, k) -> CASE WHEN {reach} < size(acc) THEN transform(acc, (x, i) -> CASE WHEN i >= {reach} THEN {joined} ELSE x END) ELSE acc END)"


_SUM = "{x} + {y}"
_MOST = "greatest({x}, {y})"


def _bound(value: str, name: str, body: str) -> str:
    """SQL: `body` with `name` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _pieces(text: str, pattern: str) -> str:
    """SQL: what `split` leaves between the matches of `pattern`, and these; the last piece has no match."""
    return f"zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0), (g, m) -> named_struct('g', g, 'm', m))"


def _found(text: str, pattern: str) -> str:
    """SQL: the matches of `pattern` with their places in code points."""
    ends = _running("transform(p, x -> length(x.g) + coalesce(length(x.m), 0))", _SUM)
    spans = f"zip_with(p, {ends}, (x, e) -> CASE WHEN x.m IS NOT NULL THEN named_struct('start', e - length(x.m), 'end', e, 'value', x.m) END)"
    return f"filter({_bound(_pieces(text, pattern), 'p', spans)}, s -> s IS NOT NULL)"


# Repeated groups are possessive: Java matches these in a loop, others by recursion.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_CARD = r"[0-9](?:[\x20\-]?[0-9]){13,}+"
_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length(s.value)), 0, (sum, k) -> sum + CASE WHEN k % 2 = 1 THEN int(substring(s.value, length(s.value) - k + 1, 1))
    ELSE int(substring('0246813579', int(substring(s.value, length(s.value) - k + 1, 1)) + 1, 1)) END) % 10 = 0"""


def _base(docs: DataFrame) -> DataFrame:
    none = f"CAST(array() AS {_SPAN})"
    df = docs.selectExpr(
        "*",
        f"CASE WHEN contains(text, '@') THEN {_found('text', _EMAIL)} ELSE {none} END AS emails",
        rf"CASE WHEN text rlike r'[0-9]\.[0-9]+\.[0-9]' THEN filter({_found('text', _IP)}, s -> forall(split(s.value, r'\.'), p -> p rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')) ELSE {none} END AS ips",
        rf"CASE WHEN text rlike r'[0-9](?:[ -]?[0-9]){{13}}' THEN transform({_found('text', _CARD)}, s -> named_struct('start', s.start, 'end', s.end, 'value', {_DIGITS})) ELSE {none} END AS runs",
        f"CASE WHEN contains(text, '+') THEN filter({_found('text', _PHONE)}, s -> length({_DIGITS}) BETWEEN 10 AND 15) ELSE {none} END AS phones",
    )
    kind = "transform({0}, s -> named_struct('start', s.start, 'kind', {1}, 'end', s.end, 'value', s.value))"
    cards = f"filter(runs, s -> length(s.value) BETWEEN 14 AND 19 AND {_LUHN})"
    return df.selectExpr(
        "* EXCEPT (emails, ips, runs, phones)",
        f"sort_array(concat({kind.format('emails', 0)}, {kind.format('ips', 1)}, {kind.format(cards, 2)}, {kind.format('phones', 3)})) AS spans",
    )


#: Words of letters; the letters of base spans are masked by _P, so that a word which holds one overlaps a span.
_WORD = rf"[\p{{L}}{_P}]{{3,}}"
_CLEAR = f"NOT contains(w, '{_P}')"


def _masked(df: DataFrame) -> DataFrame:
    """Adds `masked`: the text, code point for code point, with the letters of the spans masked; only addresses have letters."""
    pieces = f"transform({_pieces('text', _EMAIL)}, x -> concat(replace(x.g, '{_P}', ' '), coalesce(regexp_replace(x.m, '[A-Za-z]', '{_P}'), '')))"
    return df.withColumn("masked", F.expr(f"CASE WHEN contains(text, '@') THEN array_join({pieces}, '') ELSE replace(text, '{_P}', ' ') END"))


def _term_spans() -> str:
    """SQL: the spans of the words that are among `terms`, the sorted terms of a text, with their `kinds`."""
    words = f"zip_with(split(masked, r'{_WORD}', -1), regexp_extract_all(masked, r'{_WORD}', 0), (g, w) -> named_struct('n', length(g) + coalesce(length(w), 0), 'own', length(w), 'w', lower(w)))"
    ends = _running("transform(p, x -> x.n)", _SUM)
    spans = f"zip_with(transform(p, x -> named_struct('own', x.own, 'at', {place_in('terms', 'x.w')})), {ends}, (x, e) -> CASE WHEN x.at > 0 THEN named_struct('start', e - x.own, 'kind', kinds[x.at - 1], 'end', e) END)"
    return f"filter({_bound(words, 'p', spans)}, s -> s IS NOT NULL)"


def personal_data(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, least_docs: int = LEAST_DOCS, carry: list[str] | None = None) -> DataFrame:
    """`docs` with `spans`, an array of (start, kind, end) in order, base kinds and then the terms to generalise or remove.

    All columns of `docs` (or those of `carry`) stay, but for one named `spans`; `text` is read as empty where null.  Texts
    without base spans can have terms.  Repeated rows count as documents each.
    """
    carry = [c for c in carry or docs.columns if c != "spans"]
    own = [c for c in carry if c != "text"] or [F.lit(0).alias("none")]
    rows = _masked(_base(docs.select(F.struct(*own).alias("own"), F.isnull("text").alias("blank"), text_of().alias("text"))))
    rows = rows.select("own", "blank", "text", "spans", "masked", F.monotonically_increasing_id().alias("row"))
    rows = stored(rows.drop("masked"), "pii")
    rows = _masked(rows)
    words = rows.select("row", "spans", F.expr(rf"array_distinct(transform(filter(regexp_extract_all(masked, r'{_WORD}', 0), w -> {_CLEAR}), w -> lower(w)))").alias("words"))
    total = rows.agg(F.count("*").alias("n")).first()["n"]
    n_term = words.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    entities = rows.select(F.explode(F.expr("array_distinct(transform(spans, s -> s.value))")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    # An entity of fewer documents has no pair of `least_docs`.
    entities = stored(entities.where(F.col("n_entity") >= least_docs), "entities")
    held = words.where("size(spans) > 0").select("words", F.explode(F.expr("array_distinct(transform(spans, s -> s.value))")).alias("entity")).join(entities, "entity")
    pairs = held.select("entity", "n_entity", F.explode("words").alias("term")).groupBy("entity", "n_entity", "term").agg(F.count("*").alias("co"))
    n, share = F.lit(float(total)), lambda nt: F.log2(F.col("co") * n / (F.col("n_entity") * nt)) / F.col("own_bits")
    # `co` documents hold the term at least: what is not enough with these is not enough with all.
    pairs = pairs.where(F.col("co") >= least_docs).withColumn("own_bits", F.log2(n / F.col("n_entity"))).where((F.col("own_bits") > 0) & (share(F.col("co")) >= generalise_at))
    shown = (
        pairs.join(n_term, "term")
        .withColumn("share", share(F.col("n_term")))
        .where(F.col("share") >= generalise_at)
        .groupBy("term")  # if it reveals two entities, the stronger measure holds
        .agg(F.max(F.when(F.col("share") >= remove_at, 5).otherwise(4)).alias("kind"))
    )
    # Stored, so that their sizes are known before words and texts are dealt out for the joins.
    shown = stored(shown, "terms")
    hits = words.select("row", F.explode("words").alias("term")).join(shown, "term").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("term", "kind"))).alias("hits"))  # a text's own terms
    hits = stored(hits.select("row", F.col("hits.term").alias("terms"), F.col("hits.kind").alias("kinds")), "hits")
    base = "transform(spans, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end))"
    # Merged at every size: the hits grow with the texts, and are too many to broadcast on a large table.
    out = rows.join(hits.hint("merge"), "row", "left").withColumn("found", F.expr(f"CASE WHEN terms IS NULL THEN {base} ELSE sort_array(concat({base}, {_term_spans()})) END"))
    return out.select(*(F.when(~F.col("blank"), F.col("text")).alias(c) if c == "text" else F.col("own").getField(c).alias(c) for c in carry), F.col("found").alias("spans"))


def _listed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')"


def digest(found: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, n_terms, base_sha256, spans."""
    count = [F.expr(f"bigint(size(filter(spans, s -> s.kind = {k})))").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select(
        "doc_id", *count, F.expr("bigint(size(filter(spans, s -> s.kind > 3)))").alias("n_terms"),
        F.expr(f"sha2({_listed('filter(spans, s -> s.kind < 4)')}, 256)").alias("base_sha256"),
        F.expr(_listed("spans")).alias("spans"),
    )


#: A text is cut into blocks of so many code points (a power of two), so that a place in it is found without reading all that comes before.
_BLOCK_BITS = 10


def sanitised(found: DataFrame) -> DataFrame:
    """The rows of personal_data() with their text rewritten; of spans that overlap the first one names the mark.

    A term is generalised to what it looks like: a name, an abbreviation, any other term.
    """
    marks, low = ", ".join(f"'{m}'" for m in MARKS), (1 << _BLOCK_BITS) - 1
    cut = lambda a, b: (
        f"CASE WHEN {b} > {a} THEN substring(array_join(slice(z.blocks, shiftright({a}, {_BLOCK_BITS}) + 1, shiftright({b} - 1, {_BLOCK_BITS}) - shiftright({a}, {_BLOCK_BITS}) + 1), ''), ({a} & {low}) + 1, {b} - {a}) ELSE '' END"
    )
    before = "CASE WHEN i = 0 THEN 0 ELSE z.upto[i - 1] END"
    word = cut("s.start", "s.end")
    general = rf"CASE WHEN {word} rlike r'^\p{{Lu}}{{2}}' THEN '[ABBREVIATION]' WHEN {word} rlike r'^\p{{Lu}}' THEN '[NAME]' ELSE '[TERM]' END"
    mark = f"CASE WHEN s.kind = {KINDS.index('generalise')} THEN {general} ELSE element_at(array({marks}), s.kind + 1) END"
    parts = f"transform(spans, (s, i) -> CASE WHEN s.start < {before} THEN '' ELSE concat({cut(f'({before})', 's.start')}, {mark}) END)"
    blocks = rf"CASE WHEN length(text) <= {low + 1} THEN array(text) ELSE regexp_extract_all(text, r'(?s).{{1,{low + 1}}}', 0) END"
    upto = _running("transform(spans, s -> s.end)", _MOST)
    whole = f"concat(array_join({parts}, ''), {cut('z.upto[size(z.upto) - 1]', 'z.n')})"
    text = _bound(f"named_struct('blocks', {blocks}, 'upto', {upto}, 'n', length(text))", "z", whole)
    return found.withColumn("text", F.expr(f"CASE WHEN size(spans) = 0 THEN text ELSE {text} END")).drop("spans")
