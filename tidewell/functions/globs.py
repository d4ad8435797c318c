"""Shell globs as regular expressions: `*` and `?` never cross a slash; a malformed glob matches nothing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = r"(?!)"


def is_glob(text: Column) -> Column:
    return text.rlike(r"[*?\[]")


def to_regex(glob: str) -> str:
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if at == len(glob):
                return NOTHING
            out.append(re.escape(glob[at]))
            at += 1
        elif c == "[":
            inside = re.match(r"(\^?)((?:[^\]\\]|\\.)+)\]", glob[at:], re.DOTALL)
            if not inside:
                return NOTHING
            body = re.sub(r"\\(.)", lambda m: "\\" + m[1], inside[2])
            body = body.replace("[", r"\[").replace("&", r"\&")
            try:
                re.compile(f"[{body}]")
            except re.error:
                return NOTHING
            out.append(f"(?:(?!/)[{inside[1]}{body}])")
            at += inside.end()
        else:
            out.append(re.escape(c))
    return "^(?s:" + "".join(out) + ")$"


def matches_any(text: Column, globs: list[str]) -> Column:
    """Whether one of a few globs, known to the driver, matches."""
    found = F.lit(False)
    for g in globs:
        found = found | text.rlike(to_regex(g))
    return found


def regex_of(glob: Column) -> Column:
    """A glob column's regular expression, for globs of `*`, `?` and literals."""
    quoted = F.regexp_replace(glob, r"([.+^$|(){}\\\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))
