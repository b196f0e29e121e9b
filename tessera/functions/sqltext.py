"""SQL-text features and scoring as native column expressions.

Every function maps Column -> Column with built-in regex and array functions
(``regexp_extract_all``, ``array_intersect`` ...), so scoring millions of
(prediction, ground truth) pairs runs inside the JVM without Python workers.
Sets are represented as distinct arrays.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.text import ascii_ws, squash_ws, strip

# identifier characters after FROM / JOIN: quotes, brackets, word chars, dots
_TABLE_PAT = r"(?i)\b(?:FROM|JOIN)\s+([`\"\[\]\p{L}\p{N}_.]+)"
_SELECT_PAT = r"(?is)\bSELECT\s+(.*?)\bFROM\b"
_IDENT_PAT = r"[A-Za-z_][A-Za-z0-9_]*"


def _lit_array(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def normalize_sql(s: Column) -> Column:
    """Fence removal, strip, one trailing ';' dropped, whitespace collapsed (O-SC-1).

    Whitespace is collapsed first, by a pattern that passes over single spaces;
    after that only spaces are left to strip.
    """
    s = ascii_ws(F.coalesce(s, F.lit("")))
    s = F.when(F.contains(s, F.lit("```")), F.regexp_replace(s, r"(?i)```sql|```", "")).otherwise(s)
    s = F.trim(F.regexp_replace(s, r"\s(?:(?<! )|\s)\s*", " "))
    return F.trim(F.regexp_replace(s, ";$", ""))


def extract_tables(norm: Column) -> Column:
    """Table names after FROM / JOIN: outer quote stripped, last dotted part, lower (O-SC-2)."""
    raw = F.regexp_extract_all(norm, F.lit(_TABLE_PAT), 1)
    unquoted = F.filter(F.transform(raw, lambda t: F.regexp_replace(t, r"^[`\"\[]|[`\"\]]$", "")),
                        lambda t: t != "")
    return F.array_distinct(F.transform(unquoted, lambda t: F.lower(F.element_at(F.split(t, r"\."), -1))))


def extract_columns(norm: Column) -> Column:
    """Identifiers of the first SELECT list, minus keywords and t1..t10 (O-SC-3)."""
    sel = F.regexp_extract(norm, _SELECT_PAT, 1)
    sel = F.regexp_replace(sel, r"\(.*?\)", " ")
    ids = F.transform(F.regexp_extract_all(sel, F.lit(_IDENT_PAT), 0), lambda x: F.lower(x))
    kw = _lit_array(fixed.SQL_KEYWORDS)
    aliases = _lit_array(fixed.ALIAS_NAMES)
    return F.array_distinct(F.filter(ids, lambda x: ~F.array_contains(kw, F.upper(x)) & ~F.array_contains(aliases, x)))


# clause patterns that are one keyword between word boundaries: such a clause
# is present exactly when the keyword is one of the text's word runs
_WORD_CLAUSE = re.compile(r"^\\b([A-Z]+)\\b$")
_RUN = r"[\p{L}\p{N}_]+"


def extract_clauses(norm: Column, upper_words: Column | None = None) -> Column:
    """Names of the clause patterns present (O-SC-4).

    Single-keyword patterns are answered from the upper-cased word runs
    (one regex pass for all of them); the multi-token ones (GROUP BY,
    ORDER BY, '( SELECT', the aggregate alternation) keep a regex, guarded by
    a substring test.
    """
    u = F.upper(norm)
    words = F.regexp_extract_all(u, F.lit(_RUN), 0) if upper_words is None else upper_words
    arms = []
    for name, pat in fixed.CLAUSES:
        m = _WORD_CLAUSE.match(pat)
        if m:
            arms.append(F.when(F.array_contains(words, m.group(1)), F.lit(name)))
        elif name == "AGG":
            arms.append(F.when(F.arrays_overlap(words, F.array(*[F.lit(k) for k in ("COUNT", "SUM", "AVG", "MIN", "MAX")])),
                               F.lit(name)))
        else:
            guard = "SELECT" if name == "SUBQUERY" else name.split("_")[0]
            arms.append(F.when((F.instr(u, guard) > 0) & u.rlike(pat), F.lit(name)))
    return F.array_compact(F.array(*arms))


def extract_keywords(norm: Column) -> Column:
    """Upper-cased ``[A-Z_]+`` words that are SQL keywords (O-SC-5)."""
    return F.array_intersect(F.regexp_extract_all(F.upper(norm), F.lit("[A-Z_]+"), 0), _lit_array(fixed.SQL_KEYWORDS))


def sql_tokens(norm: Column) -> Column:
    """Distinct ``[A-Za-z_]+`` runs of the lower-cased text (O-SC-6)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(norm), F.lit("[A-Za-z_]+"), 0))


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of distinct arrays; 1.0 when both empty, 0.0 when one is (O-SC-7)."""
    sa, sb = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return (F.when(a == b, F.lit(1.0))
            .when((sa == 0) | (sb == 0), F.lit(0.0))
            .otherwise(both / (sa + sb - both)))


FEATURES = ("tables", "columns", "clauses", "keywords", "tokens")


def features_of_normalized(n: Column, upper_words: Column | None = None) -> Column:
    """Struct of the five feature sets of an already normalised SQL column.

    ``n`` should be a column reference: every feature reads it (the clause
    set 16 times), so it must be computed once in an earlier projection.
    """
    return F.struct(extract_tables(n).alias("tables"), extract_columns(n).alias("columns"),
                    extract_clauses(n, upper_words).alias("clauses"), extract_keywords(n).alias("keywords"),
                    sql_tokens(n).alias("tokens"))


# The same features of ASCII text.  Letter case is one to one there, so the
# patterns run over the lower-cased text and need no case-insensitive match; a
# normalised ASCII text has no whitespace but single spaces.  The distinct tokens
# are found once; keywords, and the clauses that are one word, are met among them.

def _one_of(words: list[str]) -> str:
    """Pattern of any of ``words``, by their first letters."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        heads.setdefault(w[0], []).append(re.escape(w[1:]))
    return "(?:" + "|".join(f"{h}(?:{'|'.join(rest)})" for h, rest in sorted(heads.items())) + ")"


_WORD_CLAUSES = [m.group(1) for _, pat in fixed.CLAUSES if (m := _WORD_CLAUSE.match(pat))]
_AGGREGATES = ["COUNT", "SUM", "AVG", "MIN", "MAX"]
# clauses of two signs
_PAIRS = {"GROUP_BY": r"\bgroup by\b", "ORDER_BY": r"\border by\b", "SUBQUERY": r"\( ?select\b"}
# a digit beside a letter: there a token need not be a whole word
_MIXED_WORD = r"[0-9](?:[a-z_]|(?<=[a-z_][0-9]))"
# the sought part is group 1; it is empty for the other matches
_COLUMN = f"{_one_of([k.lower() for k in fixed.SQL_KEYWORDS] + fixed.ALIAS_NAMES)}(?![a-z0-9_])|({_IDENT_PAT.replace('A-Z', '')})"
_SELECT_LIST = r"select(?<![a-z0-9_]select) (.*?)from(?<![a-z0-9_]from)(?![a-z0-9_])"
# FROM or JOIN, a name that is more than its quotes; of it, what lies between one
# outer quote on either side and after the last dot
_NAME = r"`\"\[\]a-z0-9_."
_LOW_TABLE = (r"[fj](?:(?<=f)rom|(?<=j)oin)(?<![a-z0-9_]....) " rf"(?![`\"\[]?[`\"\]]?(?![{_NAME}]))"
              rf"[`\"\[]?(?:[{_NAME}]*\.)?([{_NAME[:-1]}]*?)[`\"\]]?(?![{_NAME}])")


def _columns_of_list(sel: Column) -> Column:
    sel = F.when(F.contains(sel, F.lit("(")), F.regexp_replace(sel, r"\(.*?\)", " ")).otherwise(sel)
    return F.array_remove(F.array_distinct(F.regexp_extract_all(sel, F.lit(_COLUMN), 1)), "")


def _upper_words(words: Column) -> Column:
    return F.array_remove(F.split(F.upper(F.array_join(words, " ")), " "), "")


def _clauses_of_words(low: Column, words: Column) -> Column:
    """``words``: upper-cased, with every whole word that is a keyword."""
    arms = []
    for name, pat in fixed.CLAUSES:
        if _WORD_CLAUSE.match(pat):
            continue
        if name == "AGG":
            found = F.arrays_overlap(words, _lit_array(_AGGREGATES))
        else:
            guard = F.contains(low, F.lit("(")) if name == "SUBQUERY" else F.array_contains(words, name.split("_")[0])
            found = guard & low.rlike(_PAIRS[name])
        arms.append(F.when(found, F.lit(name)).otherwise(F.lit("")))
    return F.concat(F.array_intersect(_lit_array(_WORD_CLAUSES), words), F.array_remove(F.array(*arms), ""))


def with_sql_features(df: DataFrame, sql_col: str, out: str) -> DataFrame:
    """Add ``out`` = feature struct of ``sql_col``.

    Each step is its own projection; Catalyst keeps it there (a costly
    expression referenced many times is not collapsed into its consumers), so
    each text is normalised and split into tokens once.  The lower-cased form is
    null for text beyond ASCII, which takes the general patterns.
    """
    parts = {x: f"_{out}_{x}" for x in ("norm", "low", "tok", "sel", "key", "word", *FEATURES)}
    norm, low, tok, sel, key, word = (F.col(parts[x]) for x in ("norm", "low", "tok", "sel", "key", "word"))
    general = features_of_normalized(norm)
    plain = {"tables": F.array_distinct(F.regexp_extract_all(low, F.lit(_LOW_TABLE), 1)), "columns": _columns_of_list(sel),
             "clauses": _clauses_of_words(low, word), "keywords": key, "tokens": tok}
    return (df.withColumn(parts["norm"], normalize_sql(F.col(sql_col)))
              .withColumn(parts["low"], F.when(F.octet_length(norm) == F.length(norm), F.lower(norm)))
              .withColumns({parts["tok"]: F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z_]+"), 0)),
                            parts["sel"]: F.regexp_extract(low, _SELECT_LIST, 1)})
              .withColumn(parts["key"], _upper_words(F.array_intersect(_lit_array([k.lower() for k in fixed.SQL_KEYWORDS]), tok)))
              .withColumn(parts["word"], F.when(low.rlike(_MIXED_WORD), F.regexp_extract_all(F.upper(low), F.lit("[A-Z0-9_]+"), 0)).otherwise(key))
              .withColumns({parts[k]: F.when(low.isNull(), general[k]).otherwise(plain[k]) for k in FEATURES})
              .withColumn(out, F.struct(*[F.col(parts[k]).alias(k) for k in FEATURES]))
              .drop(*parts.values()))


def semantic_score(pred_features: Column, gt_features: Column) -> Column:
    """Weighted Jaccard over the five feature sets (O-SC-8), not rounded:
    reports round it, comparisons do not."""
    out = None
    for w, name in zip(fixed.SCORE_WEIGHTS, FEATURES):
        term = F.lit(w) * jaccard(pred_features[name], gt_features[name])
        out = term if out is None else out + term
    return out


def near_correct(score: Column) -> Column:
    """Whether an unrounded score reaches the near-correct bound (O-SC-9)."""
    return score >= F.lit(fixed.NEAR_CORRECT)


def match_form(c: Column) -> Column:
    """Upper-cased, whitespace collapsed; null is empty."""
    return squash_ws(F.upper(F.coalesce(c, F.lit(""))))


def exact_match(pred: Column, gt: Column) -> Column:
    """Upper-case + whitespace-collapse equality (O-SC-10)."""
    return match_form(pred) == match_form(gt)


def extract_sql_answer(text: Column) -> Column:
    """Body of the first ```sql fence, else of the first bare fence; stripped (O-SC-11)."""
    sql_fence = F.get(F.split(F.coalesce(F.get(F.split(text, "```sql"), 1), F.lit("")), "```"), 0)
    bare_fence = F.get(F.split(F.coalesce(F.get(F.split(text, "```"), 1), F.lit("")), "```"), 0)
    return strip(F.when(F.instr(text, "```sql") > 0, sql_fence)
                  .when(F.instr(text, "```") > 0, bare_fence)
                  .otherwise(text))


def strip_prompt_echo(response: Column, prompt_len: Column) -> Column:
    """Drop an echoed prompt: the first ``prompt_len`` chars when longer (O-SC-12)."""
    return F.when(F.length(response) > prompt_len,
                  F.substring(response, prompt_len + 1, 1 << 30)).otherwise(response)
