"""Schema text: parse, question tokens, name matching, prune, render, reformat.

All functions are native column expressions (string functions plus
higher-order array functions), so they run inside Spark tasks with no Python
workers.  A parsed schema is

    array<struct<key: string,            -- lower-cased table name
                 name: string,           -- table name as written
                 columns: array<struct<name: string, type: string>>,
                 pks: array<string>,
                 fks: array<struct<col: string, ref_table: string, ref_col: string>>>>

in schema order.  Tables and columns are de-duplicated by name the way a
dictionary would be: first position kept, last definition wins.

Parsing follows the observed rules of the compressed notation: tables are cut
at the literal ``);``; a table needs ``name(`` at its start; the first ``;``
separates columns from constraints; a column needs at least two words; PKs
come from ``PK(...)``; ``FK(...)`` constraints never yield a foreign key
under these rules (the capture stops at the first ``)``), so ``fks`` is empty.
Output order is schema order (deterministic).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.text import WS_CLASS, strip

WORD_RUN = r"[\p{L}\p{N}_]+"
def empty_str_array() -> Column:
    return F.array().cast("array<string>")

COLUMN_T = "struct<name:string,type:string>"
FK_T = "struct<col:string,ref_table:string,ref_col:string>"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Inside higher-order functions an outer expression is re-evaluated on
    every lambda call; binding it through a one-element ``transform`` keeps
    nested array logic linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def has(names: Column, field: Column) -> Column:
    """``array_contains`` of a struct's field, bound first: for every row the
    interpreted test asks its operand's type, which costs a field a synchronised
    look at its struct's type."""
    return let(field, lambda f: F.array_contains(names, f))


def among(names: Column, field: Column) -> Column:
    """``has`` for few names: ``array_contains``, interpreted, leaves its loop by
    throwing, which costs more than comparing them all."""
    return let(field, lambda f: F.exists(names, lambda x: x == f))


def _dedupe_by(arr: Column, key: str, merge) -> Column:
    """Keep the first element per ``key``; ``merge(first, last)`` builds the kept value.

    The places of equal keys become neighbours by one sort of (key, place), so
    a table of many columns costs n log n comparisons.
    """
    def body(a: Column) -> Column:
        places = F.array_sort(F.transform(a, lambda x, i: F.struct(x[key].alias("k"), i.alias("i"))))

        def pick(p: Column) -> Column:
            ends = F.filter(p, lambda x, j: (j == 0) | (F.get(p, j - 1)["k"] != x["k"]))
            last = F.filter(p, lambda x, j: (j == F.size(p) - 1) | (F.get(p, j + 1)["k"] != x["k"]))
            pairs = F.array_sort(F.zip_with(ends, last, lambda f, z: F.struct(f["i"].alias("first"), z["i"].alias("last"))))
            return F.transform(pairs, lambda x: merge(F.get(a, x["first"]), F.get(a, x["last"])))

        return let(places, pick)
    return let(arr, body)


def _parse_columns(col_part: Column) -> Column:
    pieces = F.filter(F.transform(F.split(col_part, ","), lambda c: strip(c)), lambda c: c != "")
    words = F.transform(pieces, lambda c: F.split(c, WS_CLASS + "+"))
    cols = F.transform(F.filter(words, lambda w: F.size(w) >= 2),
                       lambda w: F.struct(F.lower(w[0]).alias("name"),
                                          F.array_join(F.slice(w, 2, F.size(w) - 1), " ").alias("type")))
    return _dedupe_by(cols, "name", lambda first, last: F.struct(first["name"].alias("name"), last["type"].alias("type")))


def _parse_pks(cons: Column) -> Column:
    groups = F.regexp_extract_all(cons, F.lit(r"PK\(([^)]+)\)"), 1)
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda c: F.lower(strip(c)))))


def parse_schema(schema: Column) -> Column:
    """Schema text -> array of table structs (O-SCH-1)."""
    parts = F.transform(F.split(F.coalesce(schema, F.lit("")), r"\);"), lambda p: strip(p))
    named = F.filter(parts, lambda p: (p != "") & (F.instr(p, "(") > 0)
                     & (F.regexp_extract(p, "^(" + WORD_RUN + r")\(", 1) != ""))

    def table(p: Column) -> Column:
        name = F.regexp_extract(p, "^(" + WORD_RUN + r")\(", 1)
        content = F.substring(p, F.instr(p, "(") + 1, 1 << 30)
        semi = F.instr(content, ";")
        col_part = F.when(semi > 0, F.substring_index(content, ";", 1)).otherwise(content)
        cons = F.when(semi > 0, F.substring(content, semi + 1, 1 << 30)).otherwise(F.lit(""))
        return F.struct(F.lower(name).alias("key"), name.alias("name"),
                        _parse_columns(col_part).alias("columns"), _parse_pks(cons).alias("pks"),
                        F.array().cast(f"array<{FK_T}>").alias("fks"))

    tables = F.transform(named, table)
    return _dedupe_by(tables, "key", lambda first, last: last)


# ----------------------------------------------------------------------------- question tokens

def _synonym_map() -> Column:
    entries = []
    for key, syns in fixed.SYNONYMS:
        group = F.array(*[F.lit(x) for x in [key] + syns])
        for w in [key] + syns:
            entries += [F.lit(w), group]
    return F.create_map(*entries)


def question_tokens(question: Column) -> Column:
    """Lower-cased word set minus stopwords and 1-char words, plus synonym groups (O-SCH-2/3)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit(WORD_RUN), 0)
    stop = F.array(*[F.lit(w) for w in fixed.STOPWORDS])
    relevant = F.array_except(F.filter(words, lambda w: F.length(w) > 1), stop)
    syn = _synonym_map()
    return let(relevant, lambda r: F.array_union(
        r, F.flatten(F.transform(r, lambda w: F.coalesce(F.try_element_at(syn, w), empty_str_array())))))


def name_matches(name: Column, tokens: Column) -> Column:
    """Exact token, a '_' part of length > 1, or substring either way with tokens longer than 2 (O-SCH-4)."""
    n = F.lower(name)
    return (F.array_contains(tokens, n)
            | F.exists(F.split(n, "_"), lambda p: (F.length(p) > 1) & F.array_contains(tokens, p))
            | F.exists(tokens, lambda t: (F.length(t) > 2) & ((F.instr(n, t) > 0) | (F.instr(t, n) > 0))))


# ----------------------------------------------------------------------------- prune + render

def _names(tables: Column) -> Column:
    """Every name that may be matched: tables, columns, primary and foreign keys."""
    return F.array_distinct(F.concat(tables["key"], F.flatten(F.transform(
        tables, lambda t: F.concat(t["columns"]["name"], t["pks"], t["fks"]["col"])))))


def _matcher(tables: Column, tokens: Column):
    """``name_matches`` for lower-cased names of ``tables``: ``with_names(body)``
    passes ``body`` the test."""
    return _matching(F.array_join(_names(tables), ","), tokens)


def _matching(every: Column, tokens: Column):
    """``_matcher`` of names that are joined by commas.

    A token matters to a name only by lying in it or around it.  Tokens that lie
    in no name of the schema are dropped once; those that lie around a name are
    found in one search of all longer tokens, joined by a comma, which no token
    holds.
    """
    def with_names(body) -> Column:
        around = F.array_join(F.filter(tokens, lambda t: F.length(t) > 2), ",")
        inside = let(every, lambda names: F.filter(tokens, lambda t: F.instr(names, t) > 0))

        def given(w: Column) -> Column:
            def in_name(n: Column, t: Column) -> Column:
                part = (F.length(t) == 2) & (F.instr(t, "_") == 0) & (F.instr(F.concat(F.lit("_"), n, F.lit("_")), F.concat(F.lit("_"), t, F.lit("_"))) > 0)
                return F.when(F.length(t) > 2, F.instr(n, t) > 0).otherwise((n == t) | part)

            def matches(n: Column) -> Column:
                return ((F.length(w["around"]) > 0) & (F.instr(w["around"], n) > 0) & (F.instr(n, ",") == 0)) \
                    | ((F.size(w["inside"]) > 0) & F.exists(w["inside"], lambda t: in_name(n, t)))

            return body(matches)

        return let(F.struct(around.alias("around"), inside.alias("inside")), given)

    return with_names


def prune_plan(tables: Column) -> Column:
    """What pruning a parsed schema needs whatever the question: all names, the
    tables' keys, the keys by FK degree (out + in), then name, both descending,
    and the tables with their columns' texts."""
    def plan(ts: Column) -> Column:
        def scored(t: Column) -> Column:
            incoming = F.aggregate(ts, F.lit(0), lambda a, o: a + F.size(F.filter(o["fks"], lambda f: f["ref_table"] == t["key"])))
            return F.struct((F.size(t["fks"]) + incoming).alias("s"), t["key"].alias("k"))

        def table(t: Column) -> Column:
            columns = F.transform(t["columns"], lambda c: F.struct(
                c["name"].alias("name"), F.concat(c["name"], F.lit(" "), c["type"]).alias("text")))
            return F.struct(t["key"].alias("key"), t["name"].alias("name"), columns.alias("columns"), t["pks"].alias("pks"), t["fks"].alias("fks"))

        def all_of(names: Column) -> Column:
            return F.struct(names.alias("names"), F.array_join(names, ",").alias("every"), ts["key"].alias("keys"),
                            F.transform(F.sort_array(F.transform(ts, scored), asc=False), lambda x: x["k"]).alias("ranked"),
                            F.exists(ts, lambda t: F.size(t["fks"]) > 0).alias("linked"), F.transform(ts, table).alias("tables"))

        return let(_names(ts), all_of)

    return let(tables, plan)


def _keep_columns(t: Column, hits: Column, max_cols: int) -> Column:
    """The columns (name, text) that stay of a planned table."""
    fk = t["fks"]["col"]

    def keep(names: Column) -> Column:
        keep0 = F.array_union(F.array_union(t["pks"], fk), F.array_intersect(names, hits))

        def grow(k0: Column) -> Column:
            return F.when(F.size(k0) < 3, F.array_union(k0, F.slice(F.array_except(names, k0), 1, 3))).otherwise(k0)

        def ranked(c: Column) -> Column:
            prio = (F.when(F.array_contains(t["pks"], c), 100).otherwise(0)
                    + F.when(F.array_contains(fk, c), 50).otherwise(0)
                    + F.when(F.array_contains(hits, c), 10).otherwise(0))
            return F.struct(prio.alias("p"), c.alias("c"))

        def cap(k1: Column) -> Column:
            top = F.transform(F.slice(F.sort_array(F.transform(k1, ranked), asc=False), 1, max_cols), lambda s: s["c"])
            kept = F.when(F.size(k1) > max_cols, top).otherwise(k1)
            return let(kept, lambda k: F.filter(t["columns"], lambda c: among(k, c["name"])))

        return let(let(keep0, grow), cap)

    return let(t["columns"]["name"], keep)


def _render_with(t: Column, cols: Column, documented: bool = False) -> Column:
    kept = cols["name"]
    fks = F.filter(t["fks"], lambda f: among(kept, f["col"]) & (f["ref_table"] != "")) if documented \
        else F.filter(t["fks"], lambda f: among(kept, f["col"]))
    # observed rendering lists every PK; documented rendering only the kept ones
    pks = F.filter(t["pks"], lambda p: F.exists(kept, lambda k: k == p)) if documented else t["pks"]

    def text(keys: Column) -> Column:
        fk_strs = F.transform(keys["fks"], lambda f: F.concat(F.lit("FK("), f["col"], F.lit(" REFERENCES "), f["ref_table"],
                                                              F.lit("("), f["ref_col"], F.lit("))")))
        pk = F.when(F.size(keys["pks"]) > 0, F.concat(F.lit("PK("), F.array_join(keys["pks"], ", "), F.lit(")")))
        cons = F.when((F.size(keys["pks"]) > 0) | (F.size(keys["fks"]) > 0), F.concat(F.lit("; "), F.concat_ws(", ", pk, fk_strs))) \
            .otherwise(F.lit(""))
        return F.concat(t["name"], F.lit("("), F.array_join(cols["text"], ", "), cons, F.lit(")"))

    return let(F.struct(fks.alias("fks"), pks.alias("pks")), text)


def prune_parsed(tables: Column, tokens: Column, original: Column, min_tables: int, max_cols: int,
                 documented: bool = False) -> Column:
    """Pruned schema text from a parsed schema and question tokens (O-SCH-5..9).

    ``documented`` renders valid compressed text (tables joined by ``; ``,
    kept PKs only); otherwise the observed rendering (``); `` joins plus a
    closing ``)``)."""
    return let(prune_plan(tables), lambda plan: prune_planned(plan, tokens, original, min_tables, max_cols, documented))


def prune_planned(plan: Column, tokens: Column, original: Column, min_tables: int, max_cols: int,
                  documented: bool = False) -> Column:
    """``prune_parsed`` from a schema's ``prune_plan``, which questions share.

    Each name is matched once; then sets of names are met as wholes."""
    return F.when(F.size(plan["tables"]) == 0, original).otherwise(
        _matching(plan["every"], tokens)(lambda matches: let(F.filter(plan["names"], matches), lambda hits: _prune_with(
            plan, hits, original, min_tables, max_cols, documented))))


def _prune_with(plan: Column, hits: Column, original: Column, min_tables: int, max_cols: int, documented: bool) -> Column:
    tables = plan["tables"]
    matched = F.array_intersect(plan["keys"], hits)

    def expand(m: Column) -> Column:
        # referenced tables (one hop) and referencing tables (one ordered pass)
        refs = F.flatten(F.transform(F.filter(tables, lambda t: among(m, t["key"])),
                                     lambda t: F.transform(t["fks"], lambda f: f["ref_table"])))
        step2 = let(plan["keys"], lambda k: F.array_union(m, F.filter(refs, lambda r: F.array_contains(k, r))))
        return F.aggregate(tables, step2,
                           lambda acc, t: F.when(F.exists(t["fks"], lambda f: among(acc, f["ref_table"])),
                                                 F.array_union(acc, F.array(t["key"]))).otherwise(acc))

    # top up to min_tables by FK degree
    def top_up(s3: Column) -> Column:
        need = F.lit(min_tables) - F.size(s3)
        return F.when(need > 0, F.array_union(s3, F.slice(F.array_except(plan["ranked"], s3), 1, need))).otherwise(F.array_distinct(s3))

    selected = let(let(matched, lambda m: F.when(plan["linked"], expand(m)).otherwise(m)), top_up)
    rendered = let(selected, lambda sel: F.transform(
        F.filter(tables, lambda t: among(sel, t["key"])),
        lambda t: let(_keep_columns(t, hits, max_cols), lambda cols: _render_with(t, cols, documented))))
    if documented:
        text = let(rendered, lambda r: F.array_join(r, "; "))
    else:
        text = let(rendered, lambda r: F.when(F.size(r) > 0, F.concat(F.array_join(r, "); "), F.lit(")"))).otherwise(F.lit("")))
    return let(text, lambda tx: F.when(tx == "", original).otherwise(tx))


# ----------------------------------------------------------------------------- reformat

def _cut_tables(s: Column) -> Column:
    """Pieces of ``s`` that end where the parenthesis depth returns to 0."""
    pieces = F.split(s, r"\)")
    body = F.slice(pieces, 1, F.size(pieces) - 1)
    init = F.struct(F.lit(0).alias("d"), F.lit("").alias("cur"), empty_str_array().alias("out"))

    def step(acc: Column, p: Column) -> Column:
        d = acc["d"] + (F.length(p) - F.length(F.replace(p, F.lit("("), F.lit("")))) - 1
        cur = F.concat(acc["cur"], p, F.lit(")"))
        return F.when(d == 0, F.struct(d.alias("d"), F.lit("").alias("cur"), F.concat(acc["out"], F.array(strip(cur))).alias("out"))) \
            .otherwise(F.struct(d.alias("d"), cur.alias("cur"), acc["out"].alias("out")))

    return F.aggregate(body, init, step, lambda acc: acc["out"])


def _split_top_semicolons(content: Column) -> Column:
    return _split_top(content, ";")


def _split_top(s: Column, sep: str) -> Column:
    """Stripped, non-empty pieces of ``s`` split at ``sep`` where the paren depth is 0."""
    return let(F.split(s, re.escape(sep)), lambda pieces: _split_pieces(pieces, sep))


def _split_pieces(pieces: Column, sep: str = ";") -> Column:
    init = F.struct(F.lit(0).alias("d"), F.lit("").alias("cur"), empty_str_array().alias("out"), F.lit(0).alias("i"))
    n = F.size(pieces)

    def step(acc: Column, p: Column) -> Column:
        d = acc["d"] + (F.length(p) - F.length(F.replace(p, F.lit("("), F.lit("")))) \
            - (F.length(p) - F.length(F.replace(p, F.lit(")"), F.lit(""))))
        cur = F.concat(acc["cur"], p)
        last = acc["i"] == n - 1
        cut = last | (d == 0)
        out = F.when(cut & (strip(cur) != ""), F.concat(acc["out"], F.array(strip(cur)))).otherwise(acc["out"])
        nxt = F.when(cut, F.lit("")).otherwise(F.concat(cur, F.lit(sep)))
        return F.struct(d.alias("d"), nxt.alias("cur"), out.alias("out"), (acc["i"] + 1).alias("i"))

    return F.aggregate(pieces, init, step, lambda acc: acc["out"])


def reformat_schema(schema: Column) -> Column:
    """Compressed schema -> ``Table: x`` blocks with one line per column (O-SCH-11)."""
    tables = F.filter(_cut_tables(F.coalesce(schema, F.lit(""))), lambda t: t != "")

    def block(td: Column) -> Column:
        name = strip(F.substring_index(td, "(", 1))
        open_at = F.instr(td, "(")
        close_at = F.length(td) - F.instr(F.reverse(td), ")") + 1
        content = strip(F.substring(td, open_at + 1, close_at - open_at - 1))
        parts = _split_top_semicolons(content)
        lines = F.flatten(F.transform(parts, lambda p: F.when(
            p.startswith("PRIMARY KEY") | p.startswith("FK ") | p.startswith("FOREIGN KEY"),
            F.array(F.concat(F.lit("  "), p))).otherwise(
            F.transform(F.filter(F.transform(F.split(p, ","), lambda c: strip(c)), lambda c: c != ""),
                        lambda c: F.concat(F.lit("  - "), c)))))
        return strip(F.concat(F.lit("Table: "), name, F.lit("\n"), F.array_join(lines, "\n")))

    return F.array_join(F.transform(tables, block), "\n\n")


# ----------------------------------------------------------------------------- documented (FK-aware) parse

_N = r"[\p{L}\p{N}_]+"
FK_PATTERNS = [  # FK(col REFERENCES t(c)) | FK col->t(c) | FOREIGN KEY(col) REFERENCES t(c)
    r"(?i)^FK\s*\(\s*(" + _N + r")\s+REFERENCES\s+(" + _N + r")\s*\(\s*(" + _N + r")\s*\)\s*\)$",
    r"(?i)^FK\s+(" + _N + r")\s*->\s*(" + _N + r")\s*\(\s*(" + _N + r")\s*\)$",
    r"(?i)^FOREIGN\s+KEY\s*\(\s*(" + _N + r")\s*\)\s*REFERENCES\s+(" + _N + r")\s*\(\s*(" + _N + r")\s*\)$",
]
PK_PATTERN = r"(?i)^(?:PK|PRIMARY\s+KEY)\s*\((.*)\)$"


def _fk_struct(item: Column) -> Column:
    out = None
    for pat in FK_PATTERNS:
        st = F.struct(*[F.lower(F.regexp_extract(item, pat, g)).alias(n) for g, n in ((1, "col"), (2, "ref_table"), (3, "ref_col"))])
        out = F.when(item.rlike(pat), st) if out is None else out.when(item.rlike(pat), st)
    return out


def parse_schema_documented(schema: Column) -> Column:
    """Depth-aware, FK-aware parse of all four notations (O-SCH-1, documented mode).

    Tables are cut where the paren depth returns to 0 (so ``);``, ``)\\n``
    and ``);\\n`` separators all work); columns and constraints are split at
    depth-0 ``;`` and ``,`` (so ``DECIMAL(10,2)`` stays whole).  PKs come from
    ``PK(...)``, ``PRIMARY KEY(...)`` or a ``PK`` type word; FKs from
    ``FK(c REFERENCES t(x))``, ``FK c->t(x)``, ``FOREIGN KEY(c) REFERENCES t(x)``
    or an ``FK`` type word (target unknown: ref_table '').
    """
    cut = F.transform(_cut_tables(F.coalesce(schema, F.lit(""))), lambda td: F.regexp_replace(td, r"^[;\s]+", ""))
    tds = F.filter(cut, lambda td: td.rlike("^" + _N + r"\s*\("))

    def build(name: Column, parts: Column) -> Column:
        col_items = _split_top(F.coalesce(F.get(parts, 0), F.lit("")), ",")
        words = F.transform(col_items, lambda c: F.split(c, WS_CLASS + "+"))
        cols_raw = F.transform(F.filter(words, lambda w: F.size(w) >= 2),
                               lambda w: F.struct(F.lower(w[0]).alias("name"),
                                                  F.array_join(F.slice(w, 2, F.size(w) - 1), " ").alias("type")))
        columns = _dedupe_by(cols_raw, "name",
                             lambda first, last: F.struct(first["name"].alias("name"), last["type"].alias("type")))
        cons = F.flatten(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                                     lambda p: _split_top(p, ",")))

        def assemble(cols: Column, items: Column) -> Column:
            pk_typed = F.transform(F.filter(cols, lambda c: (F.upper(c["type"]) == "PK")
                                            | (F.instr(F.upper(c["type"]), "PRIMARY KEY") > 0)), lambda c: c["name"])
            pk_items = F.flatten(F.transform(F.filter(items, lambda x: x.rlike(PK_PATTERN)),
                                             lambda x: F.transform(F.split(F.regexp_extract(x, PK_PATTERN, 1), ","),
                                                                   lambda y: F.lower(strip(y)))))
            fk_items = F.transform(F.filter(items, lambda x: x.rlike(FK_PATTERNS[0]) | x.rlike(FK_PATTERNS[1])
                                            | x.rlike(FK_PATTERNS[2])), _fk_struct)
            fk_typed = F.transform(F.filter(cols, lambda c: F.upper(c["type"]) == "FK"),
                                   lambda c: F.struct(c["name"].alias("col"), F.lit("").alias("ref_table"),
                                                      F.lit("").alias("ref_col")))
            return F.struct(F.lower(name).alias("key"), name.alias("name"), cols.alias("columns"),
                            F.array_distinct(F.concat(pk_typed, pk_items)).alias("pks"),
                            F.concat(fk_items, fk_typed).alias("fks"))

        return let(columns, lambda cols: let(cons, lambda items: assemble(cols, items)))

    def table(td: Column) -> Column:
        name = F.regexp_extract(td, "^(" + _N + r")\s*\(", 1)
        open_at = F.instr(td, "(")
        close_at = F.length(td) - F.instr(F.reverse(td), ")") + 1
        content = F.substring(td, open_at + 1, close_at - open_at - 1)
        return let(_split_top(content, ";"), lambda parts: build(name, parts))

    return _dedupe_by(F.transform(tds, table), "key", lambda first, last: last)


def reformat_schema_documented(schema: Column) -> Column:
    """Clear rendering from the FK-aware parse (O-SCH-11, documented mode).

    ``Table: name`` then one ``  - column: TYPE`` line per column, annotated
    ``(PRIMARY KEY)`` and ``(FOREIGN KEY -> table.column)``; tables separated
    by a blank line.
    """
    def block(t: Column) -> Column:
        def line(c: Column) -> Column:
            fk = F.filter(t["fks"], lambda f: (f["col"] == c["name"]) & (f["ref_table"] != ""))
            pk_note = F.when(F.array_contains(t["pks"], c["name"]), F.lit(" (PRIMARY KEY)")).otherwise(F.lit(""))
            fk_note = F.when(F.size(fk) > 0, F.concat(F.lit(" (FOREIGN KEY -> "), fk[0]["ref_table"], F.lit("."),
                                                      fk[0]["ref_col"], F.lit(")"))).otherwise(F.lit(""))
            return F.concat(F.lit("  - "), c["name"], F.lit(": "), c["type"], pk_note, fk_note)
        return F.concat_ws("\n", F.concat(F.lit("Table: "), t["name"]), F.array_join(F.transform(t["columns"], line), "\n"))

    return let(parse_schema_documented(schema), lambda ts: F.array_join(F.transform(ts, block), "\n\n"))
