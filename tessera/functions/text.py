"""Small text helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Characters Python's str.isspace() accepts: the whitespace set of strip()/split().
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
WS_CLASS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def strip(c: Column) -> Column:
    """Whitespace strip on both ends (the full Unicode set, not only spaces).

    ``trim(BOTH set FROM x)`` -- no regex, stays in codegen.
    """
    return F.trim(c, F.lit(WHITESPACE))


# whitespace outside ASCII: mapped to a plain space with ``translate`` (a
# character map, no regex) so the collapsing regex can use the fast ASCII \s
EXOTIC_WS = "".join(c for c in WHITESPACE if c not in "\t\n\x0b\x0c\r ")
# a character that may be one of them; ``translate`` looks up every character
# of a text, so only texts that hold such a character go through it
_MAYBE_EXOTIC = r"[\x1c-\x1f\x80-\x{10ffff}]"


def ascii_ws(c: Column) -> Column:
    return F.when(c.rlike(_MAYBE_EXOTIC), F.translate(c, EXOTIC_WS, " " * len(EXOTIC_WS))).otherwise(c)


def squash_ws(c: Column) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return strip(F.regexp_replace(ascii_ws(c), r"\s+", " "))


def count_occurrences(haystack: Column, needle: str) -> Column:
    """Non-overlapping occurrence count of a literal needle."""
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def contains_any(c: Column, needles: list[str]) -> Column:
    out = None
    for n in needles:
        e = F.instr(c, n) > 0
        out = e if out is None else (out | e)
    return out


def group_label(df_cols: list[str]) -> Column:
    """Report label: query_type_name, then query_type, then 'Unknown'."""
    parts = [F.col(n) for n in ("query_type_name", "query_type") if n in df_cols]
    return F.coalesce(*parts, F.lit("Unknown"))
