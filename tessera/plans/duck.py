"""DuckDB expression builders for the oracle SQL (RE2 dialect).

These mirror the Spark column functions, written independently against
DuckDB's list/regex functions.  RE2 notes: ``\\w`` is ASCII, so Unicode word
characters are spelled ``[\\p{L}\\p{N}_]``; ``regexp_replace`` needs the ``g``
flag to replace every match.
"""

from __future__ import annotations

from tessera import fixed


def lst(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def squash(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def normalize(x: str) -> str:
    s = f"regexp_replace(coalesce({x}, ''), '```sql|```', '', 'gi')"
    s = strip(s)
    s = f"regexp_replace({s}, ';\\s*$', '')"
    return squash(s)


def tables(n: str) -> str:
    raw = f"regexp_extract_all({n}, '(?i)\\b(?:FROM|JOIN)\\s+([`\"\\[\\]\\p{{L}}\\p{{N}}_.]+)', 1)"
    unq = f"list_filter(list_transform({raw}, lambda t: regexp_replace(t, '^[`\"\\[]|[`\"\\]]$', '', 'g')), lambda t: t <> '')"
    return f"list_distinct(list_transform({unq}, lambda t: lower(string_split(t, '.')[-1])))"


def columns(n: str) -> str:
    sel = f"regexp_extract({n}, '(?is)\\bSELECT\\s+(.*?)\\bFROM\\b', 1)"
    sel = f"regexp_replace({sel}, '\\(.*?\\)', ' ', 'g')"
    ids = f"list_transform(regexp_extract_all({sel}, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x))"
    return (f"list_distinct(list_filter({ids}, lambda x: NOT list_contains({lst(fixed.SQL_KEYWORDS)}, upper(x)) "
            f"AND NOT list_contains({lst(fixed.ALIAS_NAMES)}, x)))")


def clauses(n: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({n}, '(?i){pat}') THEN '{name}' END" for name, pat in fixed.CLAUSES)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def keywords(n: str) -> str:
    return f"list_intersect(regexp_extract_all(upper({n}), '[A-Z_]+'), {lst(fixed.SQL_KEYWORDS)})"


def tokens(n: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({n}), '[A-Za-z_]+'))"


def jaccard(a: str, b: str) -> str:
    return (f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE "
            f"ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)")


FEATURE_FUNS = [tables, columns, clauses, keywords, tokens]


def score(pred_norm: str, gt_norm: str) -> str:
    terms = [f"{w}::DOUBLE * {jaccard(f(pred_norm), f(gt_norm))}" for w, f in zip(fixed.SCORE_WEIGHTS, FEATURE_FUNS)]
    return "(" + " + ".join(terms) + ")"


def exact_match(a: str, b: str) -> str:
    ua, ub = f"upper(coalesce({a}, ''))", f"upper(coalesce({b}, ''))"
    return f"({squash(ua)} = {squash(ub)})"


def extract_answer(t: str) -> str:
    return strip(
        f"CASE WHEN instr({t}, '```sql') > 0 THEN string_split(coalesce(string_split({t}, '```sql')[2], ''), '```')[1] "
        f"WHEN instr({t}, '```') > 0 THEN string_split(coalesce(string_split({t}, '```')[2], ''), '```')[1] "
        f"ELSE {t} END")


def strip_echo(r: str, plen: str) -> str:
    return f"(CASE WHEN length({r}) > {plen} THEN substr({r}, {plen} + 1) ELSE {r} END)"


def prompt_len(question: str, schema: str) -> str:
    a = len(fixed.EVAL_PROMPT) - len("{schema}") - len("{question}")
    b = len(fixed.EVAL_PROMPT_NO_SCHEMA) - len("{question}")
    q = f"coalesce(length({question}), 0)"
    return f"(CASE WHEN coalesce(length({schema}), 0) > 0 THEN {a} + length({schema}) + {q} ELSE {b} + {q} END)"


def valid_schema(s: str) -> str:
    return (f"(length(coalesce({s}, '')) > 0 AND {s} <> '{fixed.SCHEMA_NOT_AVAILABLE}' "
            f"AND length({strip(s)}) > {fixed.MIN_SCHEMA_LEN})")


# ----------------------------------------------------------------------------- schema text

WORD_RUN = "[\\p{L}\\p{N}_]+"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"(list_transform([{value}], lambda {name}: {body}))[1]"


def dedupe(arr: str, key: str, keep_last_field: str | None) -> str:
    return let(arr, f"all_{key}", _dedupe(f"all_{key}", key, keep_last_field))


def _dedupe(arr: str, key: str, keep_last_field: str | None) -> str:
    firsts = f"list_filter({arr}, lambda x, i: len(list_filter(list_slice({arr}, 1, i - 1), lambda y: y.{key} = x.{key})) = 0)"
    if keep_last_field is None:  # whole element of the last occurrence
        return f"list_transform({firsts}, lambda x: list_filter({arr}, lambda y: y.{key} = x.{key})[-1])"
    return (f"list_transform({firsts}, lambda x: {{'name': x.{key}, '{keep_last_field}': "
            f"list_filter({arr}, lambda y: y.{key} = x.{key})[-1].{keep_last_field}}})")


def parse_schema(s: str) -> str:
    parts = f"list_transform(string_split(coalesce({s}, ''), ');'), lambda p: {strip('p')})"
    named = (f"list_filter({parts}, lambda p: p <> '' AND instr(p, '(') > 0 AND "
             f"regexp_extract(p, '^({WORD_RUN})\\(', 1) <> '')")
    content = "substr(p, instr(p, '(') + 1)"
    col_part = f"(CASE WHEN instr({content}, ';') > 0 THEN split_part({content}, ';', 1) ELSE {content} END)"
    cons = f"(CASE WHEN instr({content}, ';') > 0 THEN substr({content}, instr({content}, ';') + 1) ELSE '' END)"
    pieces = f"list_filter(list_transform(string_split({col_part}, ','), lambda c: {strip('c')}), lambda c: c <> '')"
    cols = (f"list_transform(list_filter(list_transform({pieces}, lambda c: string_split_regex(c, '\\s+')), "
            f"lambda w: len(w) >= 2), lambda w: {{'name': lower(w[1]), 'type': array_to_string(w[2:], ' ')}})")
    pks = (f"flatten(list_transform(regexp_extract_all({cons}, 'PK\\(([^)]+)\\)', 1), "
           f"lambda g: list_transform(string_split(g, ','), lambda c: lower({strip('c')}))))")
    name = f"regexp_extract(p, '^({WORD_RUN})\\(', 1)"
    tables = (f"list_transform({named}, lambda p: {{'key': lower({name}), 'name': {name}, "
              f"'columns': {dedupe(cols, 'name', 'type')}, 'pks': {pks}}})")
    return dedupe(tables, "key", None)


def question_tokens(q: str) -> str:
    rel = (f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({q}, '')), '{WORD_RUN}'), "
           f"lambda w: NOT list_contains({lst(fixed.STOPWORDS)}, w) AND length(w) > 1))")
    groups = "[" + ", ".join(lst([k] + syn) for k, syn in fixed.SYNONYMS) + "]"
    return f"list_distinct(list_concat({rel}, flatten(list_filter({groups}, lambda g: len(list_intersect(g, {rel})) > 0))))"


def name_matches(n: str, tok: str) -> str:
    return (f"(list_contains({tok}, {n}) OR len(list_filter(string_split({n}, '_'), lambda np: length(np) > 1 AND "
            f"list_contains({tok}, np))) > 0 OR len(list_filter({tok}, lambda tk: length(tk) > 2 AND "
            f"(instr({n}, tk) > 0 OR instr(tk, {n}) > 0))) > 0)")


def prune(tables: str, tok: str, original: str, min_tables: int, max_cols: int) -> str:
    """Prune with the observed parse (no foreign keys: every FK degree is 0)."""
    matched = f"list_transform(list_filter({tables}, lambda t: {name_matches('t.key', tok)}), lambda t: t.key)"
    extra = (f"list_transform(list_slice(list_sort(list_transform(list_filter({tables}, lambda t: NOT list_contains("
             f"matched_, t.key)), lambda t: {{'s': 0, 'k': t.key}}), 'DESC'), 1, greatest({min_tables} - len(matched_), 0)), "
             f"lambda z: z.k)")
    selected = let(matched, "matched_", f"list_concat(matched_, {extra})")
    names = "list_transform(t.columns, lambda c: c.name)"
    keep0 = f"list_distinct(list_concat(t.pks, list_filter({names}, lambda n: {name_matches('n', tok)})))"
    remaining = f"list_filter({names}, lambda n: NOT list_contains(keep0_, n))"
    keep1 = f"(CASE WHEN len(keep0_) < 3 THEN list_distinct(list_concat(keep0_, list_slice({remaining}, 1, 3))) ELSE keep0_ END)"
    ranked = (f"list_transform(list_slice(list_sort(list_transform(keep1_, lambda c: {{'p': (CASE WHEN list_contains(t.pks, c) "
              f"THEN 100 ELSE 0 END) + (CASE WHEN {name_matches('c', tok)} THEN 10 ELSE 0 END), 'c': c}}), 'DESC'), 1, {max_cols}), "
              f"lambda z: z.c)")
    keep = let(keep0, "keep0_", let(keep1, "keep1_", f"(CASE WHEN len(keep1_) > {max_cols} THEN {ranked} ELSE keep1_ END)"))
    cols = "list_filter(t.columns, lambda c: list_contains(keep_, c.name))"
    col_str = f"array_to_string(list_transform({cols}, lambda c: c.name || ' ' || c.type), ', ')"
    render = (f"(CASE WHEN len(t.pks) > 0 THEN t.name || '(' || {col_str} || '; PK(' || array_to_string(t.pks, ', ') || '))' "
              f"ELSE t.name || '(' || {col_str} || ')' END)")
    rendered = let(selected, "selected_", f"list_transform(list_filter({tables}, lambda t: list_contains(selected_, t.key)), "
                                          f"lambda t: {let(keep, 'keep_', render)})")
    text = "(CASE WHEN len(rendered_) > 0 THEN array_to_string(rendered_, '); ') || ')' ELSE '' END)"
    return let(rendered, "rendered_", f"(CASE WHEN len({tables}) = 0 OR {text} = '' THEN {original} ELSE {text} END)")


def _count(s: str, ch: str) -> str:
    return f"(length({s}) - length(replace({s}, '{ch}', '')))"


def reformat(s: str) -> str:
    pieces = f"string_split(coalesce({s}, ''), ')')"
    body = f"list_slice({pieces}, 1, len({pieces}) - 1)"
    init = "{'d': 0, 'cur': '', 'out': []::VARCHAR[]}"
    step = (f"lambda acc, p: CASE WHEN acc.d + {_count('p', '(')} - 1 = 0 THEN "
            f"{{'d': 0, 'cur': '', 'out': list_append(acc.out, {strip(chr(39) + chr(39) + ' || acc.cur || p || ' + chr(39) + ')' + chr(39))})}} "
            f"ELSE {{'d': acc.d + {_count('p', '(')} - 1, 'cur': acc.cur || p || ')', 'out': acc.out}} END")
    tables = f"list_filter(list_reduce({body}, {step}, {init}).out, lambda t: t <> '')"
    content = (f"{strip('substr(td, instr(td, ' + chr(39) + '(' + chr(39) + ') + 1, (length(td) - instr(reverse(td), '
                     + chr(39) + ')' + chr(39) + ') + 1) - instr(td, ' + chr(39) + '(' + chr(39) + ') - 1)')}")
    semis = f"string_split({content}, ';')"
    n = f"len({semis})"
    init2 = "{'d': 0, 'cur': '', 'out': []::VARCHAR[], 'i': 1}"
    d2 = f"acc.d + {_count('p', '(')} - {_count('p', ')')}"
    cut = f"(acc.i = {n} OR {d2} = 0)"
    cur = "acc.cur || p"
    step2 = (f"lambda acc, p: {{'d': {d2}, 'cur': CASE WHEN {cut} THEN '' ELSE {cur} || ';' END, "
             f"'out': CASE WHEN {cut} AND {strip(cur)} <> '' THEN list_append(acc.out, {strip(cur)}) ELSE acc.out END, "
             f"'i': acc.i + 1}}")
    parts = f"list_reduce({semis}, {step2}, {init2}).out"
    lines = (f"flatten(list_transform({parts}, lambda p: CASE WHEN starts_with(p, 'PRIMARY KEY') OR starts_with(p, 'FK ') "
             f"OR starts_with(p, 'FOREIGN KEY') THEN ['  ' || p] ELSE list_transform(list_filter(list_transform("
             f"string_split(p, ','), lambda c: {strip('c')}), lambda c: c <> ''), lambda c: '  - ' || c) END))")
    block = f"{strip(chr(39) + 'Table: ' + chr(39) + ' || ' + strip('split_part(td, ' + chr(39) + '(' + chr(39) + ', 1)') + ' || chr(10) || array_to_string(' + lines + ', chr(10))')}"
    return f"array_to_string(list_transform({tables}, lambda td: {block}), chr(10) || chr(10))"


# ----------------------------------------------------------------------------- documented (FK-aware) schema mode

def split_top(s: str, sep: str) -> str:
    pieces = f"string_split({s}, '{sep}')"
    n = f"len({pieces})"
    init = "{'d': 0, 'cur': '', 'out': []::VARCHAR[], 'i': 1}"
    d2 = f"acc.d + {_count('p', '(')} - {_count('p', ')')}"
    cut = f"(acc.i = {n} OR {d2} = 0)"
    cur = "acc.cur || p"
    step = (f"lambda acc, p: {{'d': {d2}, 'cur': CASE WHEN {cut} THEN '' ELSE {cur} || '{sep}' END, "
            f"'out': CASE WHEN {cut} AND {strip(cur)} <> '' THEN list_append(acc.out, {strip(cur)}) ELSE acc.out END, "
            f"'i': acc.i + 1}}")
    return f"list_reduce({pieces}, {step}, {init}).out"


def ordered_distinct(lst_expr: str) -> str:
    return f"list_filter({lst_expr}, lambda x, i: NOT list_contains(list_slice({lst_expr}, 1, i - 1), x))"


def cut_tables(s: str) -> str:
    pieces = f"string_split(coalesce({s}, ''), ')')"
    body = f"list_slice({pieces}, 1, len({pieces}) - 1)"
    init = "{'d': 0, 'cur': '', 'out': []::VARCHAR[]}"
    step = (f"lambda acc, p: CASE WHEN acc.d + {_count('p', '(')} - 1 = 0 THEN "
            f"{{'d': 0, 'cur': '', 'out': list_append(acc.out, {strip(chr(39) + chr(39) + ' || acc.cur || p || ' + chr(39) + ')' + chr(39))})}} "
            f"ELSE {{'d': acc.d + {_count('p', '(')} - 1, 'cur': acc.cur || p || ')', 'out': acc.out}} END")
    return f"list_reduce({body}, {step}, {init}).out"


def parse_schema_documented(s: str) -> str:
    n_ = "[\\p{L}\\p{N}_]+"
    pk_pattern = "(?i)^(?:PK|PRIMARY\\s+KEY)\\s*\\((.*)\\)$"
    fk_patterns = [
        f"(?i)^FK\\s*\\(\\s*({n_})\\s+REFERENCES\\s+({n_})\\s*\\(\\s*({n_})\\s*\\)\\s*\\)$",
        f"(?i)^FK\\s+({n_})\\s*->\\s*({n_})\\s*\\(\\s*({n_})\\s*\\)$",
        f"(?i)^FOREIGN\\s+KEY\\s*\\(\\s*({n_})\\s*\\)\\s*REFERENCES\\s+({n_})\\s*\\(\\s*({n_})\\s*\\)$",
    ]
    tds = (f"list_filter(list_transform({cut_tables(s)}, lambda td: regexp_replace(td, '^[;\\s]+', '')), "
           f"lambda td: regexp_matches(td, '^{n_}\\s*\\('))")
    content = ("substr(td, instr(td, '(') + 1, (length(td) - instr(reverse(td), ')') + 1) - instr(td, '(') - 1)")
    parts = "parts_"
    col_items = split_top(f"coalesce(({parts})[1], '')", ",")
    cols = (f"list_transform(list_filter(list_transform({col_items}, lambda c: string_split_regex(c, '\\s+')), "
            f"lambda w: len(w) >= 2), lambda w: {{'name': lower(w[1]), 'type': array_to_string(w[2:], ' ')}})")
    columns_value = dedupe(cols, "name", "type")
    cons_value = f"flatten(list_transform(list_slice({parts}, 2, len({parts})), lambda pp: {split_top('pp', ',')}))"
    columns, cons = "columns_", "cons_"
    pk_typed = (f"list_transform(list_filter({columns}, lambda c: upper(c.type) = 'PK' OR instr(upper(c.type), 'PRIMARY KEY') > 0), "
                "lambda c: c.name)")
    pk_items = (f"flatten(list_transform(list_filter({cons}, lambda x: regexp_matches(x, '{pk_pattern}')), "
                f"lambda x: list_transform(string_split(regexp_extract(x, '{pk_pattern}', 1), ','), lambda y: lower({strip('y')}))))")
    arms = " ".join(f"WHEN regexp_matches(x, '{p}') THEN {{'col': lower(regexp_extract(x, '{p}', 1)), "
                    f"'ref_table': lower(regexp_extract(x, '{p}', 2)), 'ref_col': lower(regexp_extract(x, '{p}', 3))}}"
                    for p in fk_patterns)
    fk_items = (f"list_transform(list_filter({cons}, lambda x: " + " OR ".join(f"regexp_matches(x, '{p}')" for p in fk_patterns)
                + f"), lambda x: CASE {arms} END)")
    fk_typed = (f"list_transform(list_filter({columns}, lambda c: upper(c.type) = 'FK'), "
                "lambda c: {'col': c.name, 'ref_table': '', 'ref_col': ''})")
    name = f"regexp_extract(td, '^({n_})\\s*\\(', 1)"
    pks = let(f"list_concat({pk_typed}, {pk_items})", "pks_", ordered_distinct("pks_"))
    table = (f"{{'key': lower({name}), 'name': {name}, 'columns': {columns}, 'pks': {pks}, "
             f"'fks': list_concat({fk_items}, {fk_typed})}}")
    table = let(split_top(content, ";"), parts, let(columns_value, columns, let(cons_value, cons, table)))
    return dedupe(f"list_transform({tds}, lambda td: {table})", "key", None)


def prune_documented_ctes(pairs: str, min_tables: int, max_cols: int) -> str:
    """CTEs that prune the distinct (question, s, tok, tables) rows of ``pairs``
    in documented mode, a step per CTE so that each value is computed once.
    The last one, ``pruned``, has question, s, n_tables and text."""
    names = "list_transform(t.columns, lambda c: c.name)"
    refs = ("flatten(list_transform(list_filter(tables, lambda t: list_contains(matched, t.key)), "
            "lambda t: list_transform(t.fks, lambda f: f.ref_table)))")
    closed = ("list_reduce(tables, lambda acc, t: CASE WHEN len(list_filter(t.fks, lambda f: list_contains(acc, f.ref_table))) > 0 "
              "AND NOT list_contains(acc, t.key) THEN list_append(acc, t.key) ELSE acc END, step2)")
    degree = ("CAST(len(t.fks) + list_sum(list_transform(tables, lambda o: len(list_filter(o.fks, lambda f: f.ref_table = t.key)))) "
              "AS BIGINT)")
    extra = (f"list_transform(list_slice(list_sort(list_transform(list_filter(tables, lambda t: NOT list_contains(step3, t.key)), "
             f"lambda t: {{'s': {degree}, 'k': t.key}}), 'DESC'), 1, greatest({min_tables} - len(step3), 0)), lambda z: z.k)")
    ranked = (f"list_transform(list_slice(list_sort(list_transform(keep1, lambda c: {{'p': (CASE WHEN list_contains(t.pks, c) "
              f"THEN 100 ELSE 0 END) + (CASE WHEN list_contains(fkc, c) THEN 50 ELSE 0 END) + "
              f"(CASE WHEN list_contains(hits, c) THEN 10 ELSE 0 END), 'c': c}}), 'DESC'), 1, {max_cols}), lambda z: z.c)")
    fk_strs = ("list_transform(list_filter(t.fks, lambda f: list_contains(kept, f.col) AND f.ref_table <> ''), "
               "lambda f: 'FK(' || f.col || ' REFERENCES ' || f.ref_table || '(' || f.ref_col || '))')")
    m = "AS MATERIALIZED"
    return f"""
d1 {m} (SELECT *, list_transform(list_filter(tables, lambda t: {name_matches('t.key', 'tok')}), lambda t: t.key) AS matched,
  list_transform(tables, lambda t: t.key) AS keys FROM {pairs}),
d2 {m} (SELECT *, list_distinct(list_concat(matched, list_filter({refs}, lambda r: list_contains(keys, r)))) AS step2 FROM d1),
d3 {m} (SELECT *, {closed} AS step3 FROM d2),
d4 {m} (SELECT question, s, tok, tables, list_concat(step3, {extra}) AS selected FROM d3),
e0 {m} (SELECT question, s, tok, selected, unnest(tables) AS t, generate_subscripts(tables, 1) AS pos FROM d4),
e1 {m} (SELECT question, s, pos, t, {names} AS cols, list_transform(t.fks, lambda f: f.col) AS fkc,
  list_filter({names}, lambda n: {name_matches('n', 'tok')}) AS hits FROM e0 WHERE list_contains(selected, t.key)),
e2 {m} (SELECT *, list_distinct(list_concat(t.pks, fkc, hits)) AS keep0 FROM e1),
e3 {m} (SELECT *, CASE WHEN len(keep0) < 3 THEN list_distinct(list_concat(keep0,
  list_slice(list_filter(cols, lambda n: NOT list_contains(keep0, n)), 1, 3))) ELSE keep0 END AS keep1 FROM e2),
e4 {m} (SELECT *, CASE WHEN len(keep1) > {max_cols} THEN {ranked} ELSE keep1 END AS keep FROM e3),
e5 {m} (SELECT *, list_filter(t.columns, lambda c: list_contains(keep, c.name)) AS shown,
  list_filter(cols, lambda c: list_contains(keep, c)) AS kept FROM e4),
e6 {m} (SELECT *, list_concat(CASE WHEN len(list_filter(t.pks, lambda p: list_contains(kept, p))) > 0
  THEN ['PK(' || array_to_string(list_filter(t.pks, lambda p: list_contains(kept, p)), ', ') || ')'] ELSE []::VARCHAR[] END,
  {fk_strs}) AS cons FROM e5),
pruned {m} (SELECT question, s, string_agg(t.name || '(' || array_to_string(list_transform(shown, lambda c: c.name || ' ' || c.type), ', ')
  || CASE WHEN len(cons) > 0 THEN '; ' || array_to_string(cons, ', ') ELSE '' END || ')', '; ' ORDER BY pos) AS text
  FROM e6 GROUP BY question, s)"""


def reformat_documented(s: str) -> str:
    fk = "list_filter(t.fks, lambda f: f.col = c.name AND f.ref_table <> '')"
    line = (f"'  - ' || c.name || ': ' || c.type || CASE WHEN list_contains(t.pks, c.name) THEN ' (PRIMARY KEY)' ELSE '' END "
            f"|| CASE WHEN len({fk}) > 0 THEN ' (FOREIGN KEY -> ' || ({fk})[1].ref_table || '.' || ({fk})[1].ref_col || ')' ELSE '' END")
    block = (f"concat_ws(chr(10), 'Table: ' || t.name, array_to_string(list_transform(t.columns, lambda c: {line}), chr(10)))")
    return f"array_to_string(list_transform({parse_schema_documented(s)}, lambda t: {block}), chr(10) || chr(10))"


# ----------------------------------------------------------------------------- classification

def classify(sql: str) -> str:
    """The 13-way classification rule chain as DuckDB SQL text."""
    u = f"upper(coalesce({sql}, ''))"
    has = lambda s: f"(instr({u}, '{s}') > 0)"
    cnt = lambda s: f"((length({u}) - length(replace({u}, '{s}', ''))) // {len(s)})"
    after = f"substr(coalesce(string_split({u}, 'NOT IN')[2], ''), 1, {fixed.NOT_IN_WINDOW})"
    any_of = lambda xs: "(" + " OR ".join(has(x) for x in xs) + ")"
    j = cnt(" JOIN ")
    return f"""CASE
  WHEN {has('NOT EXISTS')} THEN 'anti_join_not_exists'
  WHEN {has('LEFT JOIN')} AND {has('IS NULL')} THEN 'anti_join_left_null'
  WHEN {has('NOT IN')} AND instr({after}, 'SELECT') > 0 THEN 'anti_join_not_in'
  WHEN {has('CASE')} OR {has('WHEN')} THEN 'complex_case'
  WHEN {cnt('SELECT')} > 1 THEN 'subquery'
  WHEN {any_of(fixed.DATE_MARKERS)} THEN 'date_filtering'
  WHEN {j} >= 3 THEN '4plus_table_join'
  WHEN {j} = 2 THEN '3_table_join'
  WHEN {j} = 1 AND {has('GROUP BY')} THEN '2_table_join_agg'
  WHEN {j} = 1 THEN '2_table_join'
  WHEN {has('GROUP BY')} OR {any_of(fixed.AGG_MARKERS)} THEN 'single_table_agg'
  WHEN {has('WHERE')} THEN 'single_table_where'
  ELSE 'simple_select' END"""
