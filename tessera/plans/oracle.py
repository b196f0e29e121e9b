"""DuckDB SQL for every registered query that SQL can express.

Each string runs on DuckDB with the driver tables registered as views; the
derived fixtures are defined in a leading ``WITH`` clause.
"""

from __future__ import annotations

from tessera import fixed
from tessera.operators.evaluate import BEST_MODEL_LABELS, VARIANT_LABELS, VARIANT_NAMES
from tessera.plans import duck as d
from tessera.sources import fixtures as fx

ORACLE: dict[str, str] = {}

SEED = "42"


def _with(*fixture_names: str, extra: str = "") -> str:
    head = fx.duck_ctes(*fixture_names).rstrip()
    return head + ("," + extra if extra else "") + "\n"


CLASSIFIED = f"classified AS (SELECT e.*, {d.classify('e.\"SQL\"')} AS query_type FROM examples e)"

ORACLE["cl_classify_examples"] = _with("examples", extra=CLASSIFIED) + "SELECT ex_id, query_type FROM classified"

ORACLE["cu_class_distribution"] = _with("examples", extra=CLASSIFIED) + (
    "SELECT query_type, count(*) AS n FROM classified GROUP BY query_type ORDER BY query_type")

RANKED = (f"ranked AS (SELECT c.*, row_number() OVER (PARTITION BY query_type ORDER BY "
          f"md5(concat_ws('|', '{SEED}', CAST(ex_id AS VARCHAR))), ex_id) AS rn FROM classified c),\n"
          "sample AS (SELECT r.* FROM ranked r JOIN targets t ON r.query_type = t.query_type WHERE r.rn <= t.target)")
SAMPLE = CLASSIFIED + ",\n" + RANKED

ORACLE["cu_stratified_sample"] = _with("examples", "targets", extra=SAMPLE) + "SELECT ex_id, query_type, rn FROM sample"

COUNTS = ("counts AS (SELECT query_type, count(*) AS available FROM classified GROUP BY query_type),\n"
          "deficit AS (SELECT t.query_type, t.target, coalesce(c.available, 0) AS available, "
          "greatest(t.target - coalesce(c.available, 0), 0) AS deficit FROM targets t LEFT JOIN counts c "
          "ON t.query_type = c.query_type)")
DEFICIT = CLASSIFIED + ",\n" + COUNTS

ORACLE["cu_class_deficit"] = _with("examples", "targets", extra=DEFICIT) + (
    "SELECT query_type, target, available, deficit FROM deficit")


def _bank_sql() -> str:
    rows = []
    for q, ts in fixed.SYNTHETIC_TEMPLATES.items():
        for i, (a, b, c) in enumerate(ts):
            rows.append(f"('{q}', {len(ts)}, {i}, {fx.duck_str(a)}, {fx.duck_str(b)}, {fx.duck_str(c)})")
    return "bank AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS b(query_type, k, idx, question, \"SQL\", db_schema))"


GEN = (_bank_sql() + ",\n"
       "gen AS (SELECT query_type, deficit, unnest(range(deficit)) AS i FROM deficit WHERE deficit > 0),\n"
       "synth AS (SELECT g.query_type, g.i, b.question, b.\"SQL\", b.db_schema FROM gen g JOIN bank b "
       "ON b.query_type = g.query_type AND b.idx = g.i % b.k)")
SYNTH = DEFICIT + ",\n" + GEN

ORACLE["cu_synthetic_rows"] = _with("examples", "targets", extra=SYNTH) + (
    "SELECT query_type, i, question, \"SQL\", db_schema FROM synth")

BALANCED = (CLASSIFIED + ",\n" + RANKED + ",\n" + COUNTS + ",\n" + GEN + ",\n"
            "bal0 AS (SELECT 'b:' || CAST(ex_id AS VARCHAR) AS row_key, 'sampled' AS source, query_type, db_id, "
            "question, \"SQL\", db_schema FROM sample\n"
            "  UNION ALL SELECT 's:' || query_type || ':' || CAST(i AS VARCHAR), 'synthetic', query_type, NULL, "
            "question, \"SQL\", db_schema FROM synth),\n"
            f"bal AS (SELECT *, md5(concat_ws('|', '{SEED}', row_key)) AS shuffle_key FROM bal0)")

ORACLE["cu_balanced_dataset"] = _with("examples", "targets", extra=BALANCED) + (
    "SELECT row_key, source, query_type, db_id, question, \"SQL\", db_schema, shuffle_key FROM bal "
    "ORDER BY shuffle_key, row_key")

ORACLE["cu_target_check"] = _with("examples", "targets", extra=BALANCED) + (
    f"SELECT a.query_type, a.actual, coalesce(t.target, 0) AS target, "
    f"abs(a.actual - coalesce(t.target, 0)) <= {fixed.TARGET_TOLERANCE} AS ok "
    f"FROM (SELECT {d.classify('\"SQL\"')} AS query_type, count(*) AS actual FROM bal GROUP BY 1) a "
    f"LEFT JOIN targets t ON a.query_type = t.query_type ORDER BY a.query_type")

SPLIT = (BALANCED + ",\n"
         f"split AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY shuffle_key DESC, row_key DESC) <= "
         f"{fixed.DEV_SUBSET_SIZE} THEN 'dev' ELSE 'train' END AS split FROM bal)")

ORACLE["cu_tail_split"] = _with("examples", "targets", extra=SPLIT) + "SELECT row_key, split FROM split"

ORACLE["cu_dataset_report"] = _with("examples", "targets", extra=SPLIT) + (
    "SELECT count(*) AS total, count_if(split = 'train') AS n_train, count_if(split = 'dev') AS n_dev FROM split")

ORACLE["cu_overlap_check"] = _with("examples", "targets", extra=SPLIT + ",\n"
    f"qk AS (SELECT DISTINCT lower({d.normalize('question')}) AS k FROM split WHERE split = 'train'),\n"
    f"sk AS (SELECT DISTINCT lower({d.normalize(chr(34) + 'SQL' + chr(34))}) AS k FROM split WHERE split = 'train'),\n"
    f"t AS (SELECT ex_id, db_id, lower({d.normalize('question')}) AS q, lower({d.normalize(chr(34) + 'SQL' + chr(34))}) AS s "
    f"FROM examples WHERE {d.valid_schema('db_schema')})") + (
    "SELECT t.db_id, count(*) AS n_test, count_if(qk.k IS NOT NULL OR sk.k IS NOT NULL) AS n_overlap "
    "FROM t LEFT JOIN qk ON t.q = qk.k LEFT JOIN sk ON t.s = sk.k GROUP BY t.db_id")

# ---------------------------------------------------------------- features / score
_FEATS = [("tables", d.tables), ("columns", d.columns), ("clauses", d.clauses), ("keywords", d.keywords),
          ("tokens", d.tokens)]

ORACLE["sc_sql_features"] = _with("predictions") + (
    "SELECT ex_id, variant, " + ", ".join(f"list_sort({f('n')}) AS {name}" for name, f in _FEATS) +
    f" FROM (SELECT ex_id, variant, {d.normalize('raw_answer')} AS n FROM predictions)")

ORACLE["sc_semantic_score"] = _with("predictions") + (
    f"SELECT ex_id, variant, round(score, 6) AS score, score >= {fixed.NEAR_CORRECT} AS near_correct FROM ("
    f"SELECT p.ex_id, p.variant, {d.score('pn', 'gn')} AS score FROM "
    f"(SELECT ex_id, variant, {d.normalize('raw_answer')} AS pn FROM predictions) p JOIN "
    f"(SELECT ex_id, {d.normalize(chr(34) + 'SQL' + chr(34))} AS gn FROM examples) g ON p.ex_id = g.ex_id)")

# ---------------------------------------------------------------- evaluation
ORACLE["pf_valid_schema"] = _with("examples") + f"SELECT ex_id, db_id FROM examples WHERE {d.valid_schema('db_schema')}"

ORACLE["pf_head_n"] = _with("examples") + (
    f"SELECT ex_id, coalesce(query_type_name, 'Unknown') AS label, row_number() OVER (ORDER BY ex_id) <= {fixed.MAX_TEST_SAMPLES} "
    f"AS in_head FROM examples WHERE {d.valid_schema('db_schema')}")

_plen = "(CASE WHEN p.variant = 'finetuned_prune' THEN p.pruned_prompt_len ELSE p.prompt_len END)"
_resp = f"CASE WHEN p.variant <> 'llama' THEN {d.strip_echo('p.raw_answer', _plen)} ELSE p.raw_answer END"
# the catalog / prune CTEs used for the pruned-prompt length
_EV_CAT = ("evcat AS (SELECT sch, " + d.parse_schema("sch") + " AS tables FROM (SELECT DISTINCT coalesce(db_schema, '') AS sch "
           f"FROM examples WHERE {d.valid_schema('db_schema')})),\n"
           "evt AS (SELECT e.*, " + d.question_tokens("e.question") + " AS tok, c.tables FROM examples e JOIN evcat c "
           f"ON coalesce(e.db_schema, '') = c.sch WHERE {d.valid_schema('e.db_schema')}),\n"
           "evp AS (SELECT *, " + d.prune("tables", "tok", "db_schema", *fixed.PRUNE_EVAL) + " AS pruned_schema FROM evt)")
_EV_VARIANTS = ", ".join(f"('{v}')" for v in VARIANT_NAMES)
LONG = (
    _EV_CAT + ",\n"
    f"ex AS (SELECT ex_id, coalesce(query_type_name, 'Unknown') AS label, \"SQL\" AS gt_sql, "
    f"{d.prompt_len('question', 'db_schema')} AS prompt_len, "
    f"CASE WHEN coalesce(length(db_schema), 0) > 0 AND coalesce(length(question), 0) > 0 THEN "
    f"{d.prompt_len('question', 'pruned_schema')} ELSE {d.prompt_len('question', 'db_schema')} END AS pruned_prompt_len "
    f"FROM evp),\n"
    # every example has a row per variant; an absent prediction is a missing answer
    f"grid AS (SELECT e.*, v.variant, p.raw_answer FROM ex e, (VALUES {_EV_VARIANTS}) AS v(variant) "
    "LEFT JOIN {PREDICTIONS} p ON p.ex_id = e.ex_id AND p.variant = v.variant),\n"
    f"ans AS (SELECT p.ex_id, p.label, p.variant, p.gt_sql, p.raw_answer IS NULL AS missing, {d.extract_answer(_resp)} AS answer "
    "FROM grid p),\n"
    f"long0 AS (SELECT ex_id, label, variant, answer, missing, "
    f"CASE WHEN (variant IN ('finetuned_no_prune', 'finetuned_prune') AND starts_with(coalesce(answer, ''), 'SKIPPED')) "
    f"OR (variant = 'llama' AND starts_with(coalesce(answer, ''), 'ERROR')) THEN NULL "
    f"ELSE NOT missing AND {d.exact_match('answer', 'gt_sql')} END AS correct, "
    f"CASE WHEN missing THEN 0.0::DOUBLE ELSE {d.score(d.normalize('answer'), d.normalize('gt_sql'))} END AS raw_score FROM ans),\n"
    f"long AS (SELECT ex_id, label, variant, answer, missing, correct, round(raw_score, 6) AS score, "
    f"raw_score >= {fixed.NEAR_CORRECT} AS near_correct FROM long0),\n"
    "wide AS (SELECT ex_id, label, CAST(count_if(missing) AS INTEGER) AS n_missing, " + ", ".join(
        f"max(CASE WHEN variant = '{v}' THEN answer END) AS {v}_answer, "
        f"max(CASE WHEN variant = '{v}' THEN correct END) AS {v}_correct" for v in VARIANT_NAMES) +
    " FROM long GROUP BY ex_id, label)")
LONG_MISSING = LONG.replace("{PREDICTIONS}", "(SELECT * FROM predictions WHERE ex_id % 4 <> 1 AND NOT (ex_id % 4 = 2 AND variant = 'base'))")
LONG = LONG.replace("{PREDICTIONS}", "predictions")

ORACLE["ev_evaluate"] = _with("predictions", extra=LONG) + "SELECT * FROM long"

ORACLE["ev_results_wide"] = _with("predictions", extra=LONG) + "SELECT * FROM wide"


def _winner_sql() -> str:
    best = "greatest(" + ", ".join(f"{v}_n" for v in VARIANT_NAMES) + ")"
    arms = " ".join(f"WHEN {v}_n = {best} AND {v}_n > 0 THEN '{VARIANT_LABELS[v]}'" for v in VARIANT_NAMES)
    return f"CASE {arms} ELSE '{fixed.NO_WINNER}' END"


BY_TYPE = (LONG + ",\n"
           "agg AS (SELECT label, count(*) AS total, CAST(sum(n_missing) AS BIGINT) AS n_missing, " +
           ", ".join(f"count_if(coalesce({v}_correct, false)) AS {v}_n" for v in VARIANT_NAMES) +
           " FROM wide GROUP BY label),\n"
           "by_type AS (SELECT label, total, n_missing, " + ", ".join(f"{v}_n" for v in VARIANT_NAMES) + ", " +
           ", ".join(f"round(CAST({v}_n AS DOUBLE) * 100 / total, 6) AS {v}_pct" for v in VARIANT_NAMES) +
           f", {_winner_sql()} AS winner FROM agg)")

ORACLE["ev_accuracy_by_type"] = _with("predictions", extra=BY_TYPE) + "SELECT * FROM by_type ORDER BY label"


def _overall_sql() -> str:
    t = lambda v: f"coalesce({v}_correct, false)"
    counts = ", ".join(f"count_if({t(v)}) AS {v}_n" for v in VARIANT_NAMES)
    frac = lambda x: f"CASE WHEN total > 0 THEN round(CAST({x} AS DOUBLE) / total, 6) ELSE 0.0::DOUBLE END"
    best = "greatest(" + ", ".join(f"{v}_n" for v in VARIANT_NAMES) + ")"
    best_model = "CASE " + " ".join(f"WHEN {v}_n = {best} THEN '{BEST_MODEL_LABELS[v]}'" for v in VARIANT_NAMES) + " END"
    return (
        f"SELECT total, n_missing, {', '.join(f'{v}_n' for v in VARIANT_NAMES)}, "
        + ", ".join(f"{frac(f'{v}_n')} AS {v}_acc" for v in VARIANT_NAMES)
        + f", {frac('finetuned_prune_n - finetuned_no_prune_n')} AS pruning_difference, pruning_helps, pruning_hurts, "
        "CASE WHEN finetuned_prune_n > finetuned_no_prune_n THEN 'helps' WHEN finetuned_prune_n < finetuned_no_prune_n "
        "THEN 'hurts' ELSE 'no effect' END AS pruning_effect, "
        f"{best_model} AS best_model, "
        f"CASE WHEN total > 0 THEN round(CAST({best} AS DOUBLE) * 100 / total, 6) ELSE 0.0::DOUBLE END AS best_pct "
        f"FROM (SELECT count(*) AS total, CAST(coalesce(sum(n_missing), 0) AS BIGINT) AS n_missing, {counts}, "
        f"count_if({t('finetuned_prune')} AND NOT {t('finetuned_no_prune')}) AS pruning_helps, "
        f"count_if({t('finetuned_no_prune')} AND NOT {t('finetuned_prune')}) AS pruning_hurts FROM wide)")


ORACLE["ev_overall_accuracy"] = _with("predictions", extra=LONG) + _overall_sql()
ORACLE["ev_missing_predictions"] = _with("predictions", extra=LONG_MISSING) + _overall_sql()
ORACLE["io_report"] = _with("predictions", extra=LONG + f",\noverall AS ({_overall_sql()})") + (
    "SELECT " + ", ".join(f"{v}_acc AS {v}" for v in VARIANT_NAMES) +
    ", pruning_difference AS difference, pruning_helps, pruning_hurts, n_missing, "
    f"CAST({fixed.PRUNE_EVAL[1]} AS BIGINT) AS max_columns FROM overall")

ORACLE["ev_category_wins"] = _with("predictions", extra=BY_TYPE) + (
    "SELECT " + ", ".join(f"count_if(winner = '{lab}') AS wins_{v}" for v, lab in fixed.VARIANTS) +
    f", count_if(winner = '{fixed.NO_WINNER}') AS wins_tie_none, count(*) AS n_labels FROM by_type")

ORACLE["ev_score_distribution"] = _with("predictions", extra=LONG) + (
    "SELECT variant, label, count(*) AS n, round(avg(score), 6) AS avg_score, round(median(score), 6) AS median_score, "
    "count_if(near_correct) AS n_near_correct, count_if(correct) AS n_exact "
    "FROM long GROUP BY variant, label")

# ---------------------------------------------------------------- workload classes
from tessera.plans.workload import WORKLOAD_SQL  # noqa: E402

ORACLE.update(WORKLOAD_SQL)

# ---------------------------------------------------------------- schema text
ORACLE["sch_question_tokens"] = _with("examples") + (
    f"SELECT ex_id, list_sort({d.question_tokens('question')}) AS tokens FROM examples")

ORACLE["sch_document_tokens"] = f"SELECT doc_id, list_sort({d.question_tokens('text')}) AS tokens FROM documents"

CATALOG = ("cat AS (SELECT md5(s) AS schema_id, s, " + d.parse_schema("s") +
           " AS tables FROM (SELECT DISTINCT coalesce(db_schema, '') AS s FROM examples))")

ORACLE["sch_catalog_tables"] = _with("examples", extra=CATALOG) + (
    "SELECT schema_id, CAST(pos - 1 AS INTEGER) AS table_pos, t.key AS table_key, t.name AS table_name, t.pks AS pks, "
    "len(t.columns) AS n_columns FROM (SELECT schema_id, unnest(tables) AS t, generate_subscripts(tables, 1) AS pos FROM cat)")

ORACLE["sch_catalog_columns"] = _with("examples", extra=CATALOG) + (
    "SELECT schema_id, table_key, CAST(pos - 1 AS INTEGER) AS col_pos, c.name AS col_name, c.type AS col_type FROM ("
    "SELECT schema_id, t.key AS table_key, unnest(t.columns) AS c, generate_subscripts(t.columns, 1) AS pos FROM ("
    "SELECT schema_id, unnest(tables) AS t FROM cat))")

PRUNE_INPUT = CATALOG + (",\npj AS (SELECT e.ex_id, e.question, e.db_schema, " + d.question_tokens("e.question") +
                         " AS tok, c.tables FROM examples e JOIN cat c ON coalesce(e.db_schema, '') = c.s)")


def _prune_sql(mt: int, mc: int) -> str:
    return _with("examples", extra=PRUNE_INPUT) + (
        f"SELECT ex_id, {d.prune('tables', 'tok', 'db_schema', mt, mc)} AS pruned_schema FROM pj")


ORACLE["sch_prune_eval"] = _prune_sql(*fixed.PRUNE_EVAL)
ORACLE["sch_prune_train"] = _prune_sql(*fixed.PRUNE_TRAIN)
ORACLE["sch_prune_dataset_report"] = _with("examples", extra=PRUNE_INPUT + (
    f",\npr AS (SELECT db_schema, {d.prune('tables', 'tok', 'db_schema', *fixed.PRUNE_TRAIN)} AS pruned_schema FROM pj)")) + (
    "SELECT count(*) AS n_total, count_if(pruned_schema <> db_schema) AS n_pruned, "
    "round(CAST(count_if(pruned_schema <> db_schema) AS DOUBLE) * 100.0 / count(*), 6) AS pct_pruned FROM pr")

ORACLE["sch_reformat"] = _with("examples", extra=(
    "rf AS (SELECT s, " + d.reformat("s") + " AS formatted_schema FROM (SELECT DISTINCT coalesce(db_schema, '') AS s FROM examples))")) + (
    "SELECT e.ex_id, rf.formatted_schema FROM examples e JOIN rf ON coalesce(e.db_schema, '') = rf.s")

# ---------------------------------------------------------------- prompts, model inputs, chat
import re as _re  # noqa: E402


def _fill(template: str, **cols: str) -> str:
    out = []
    for p in _re.split(r"(\{[a-z_]+\})", template):
        if p.startswith("{") and p.endswith("}"):
            out.append(f"coalesce({cols[p[1:-1]]}, '')")
        elif p:
            out.append(fx.duck_str(p))
    return "(" + " || ".join(out) + ")"


def _eval_prompt(q: str, s: str) -> str:
    return (f"(CASE WHEN coalesce(length({s}), 0) > 0 THEN {_fill(fixed.EVAL_PROMPT, schema=s, question=q)} "
            f"ELSE {_fill(fixed.EVAL_PROMPT_NO_SCHEMA, question=q)} END)")


_TRAIN_IN = _fill(fixed.TRAIN_PROMPT, schema="db_schema", question="question")
ORACLE["pr_train_prompt"] = _with("examples") + (
    f"SELECT ex_id, {_TRAIN_IN} AS input, coalesce(\"SQL\", '') AS output, {_TRAIN_IN} || coalesce(\"SQL\", '') AS full_text "
    "FROM examples")

ORACLE["pr_train_prompt_pruned"] = _with("examples", extra=PRUNE_INPUT) + (
    f"SELECT ex_id, {_fill(fixed.TRAIN_PROMPT, schema='pruned_schema', question='question')} AS input FROM ("
    f"SELECT ex_id, question, {d.prune('tables', 'tok', 'db_schema', *fixed.PRUNE_TRAIN)} AS pruned_schema FROM pj)")

_VARIANTS = ", ".join(f"({i}, '{v}')" for i, (v, _) in enumerate(fixed.VARIANTS))
ORACLE["pr_eval_prompts"] = _with("examples", extra=PRUNE_INPUT + (
    f",\npv AS (SELECT ex_id, question, db_schema, {d.prune('tables', 'tok', 'db_schema', *fixed.PRUNE_EVAL)} AS pruned_schema "
    f"FROM pj WHERE {d.valid_schema('db_schema')})")) + (
    "SELECT ex_id, variant, CASE WHEN variant = 'finetuned_prune' AND coalesce(length(db_schema), 0) > 0 "
    f"AND coalesce(length(question), 0) > 0 THEN {_eval_prompt('question', 'pruned_schema')} "
    f"WHEN variant = 'llama' THEN {_eval_prompt('question', 'db_schema')} || {fx.duck_str(fixed.LLAMA_SUFFIX)} "
    f"ELSE {_eval_prompt('question', 'db_schema')} END AS prompt FROM pv, (VALUES {_VARIANTS}) AS v(ord, variant)")

_L = fixed.MAX_SEQ_LEN
_IGN = f"CAST({fixed.IGNORE_INDEX} AS INTEGER)"
WINDOWS = (
    f"WITH tk AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{d.WORD_RUN}'), lambda w: CAST(length(w) AS INTEGER)) AS ids "
    "FROM documents),\n"
    f"wn AS (SELECT doc_id, ids, CAST(unnest(range(greatest(CAST(ceil(len(ids) / {_L}) AS BIGINT), 1))) AS INTEGER) AS window_idx, "
    "(len(ids) * 3) // 4 AS input_len FROM tk),\n"
    f"tr AS (SELECT doc_id, window_idx, len(ids) > {_L} AS truncated, list_slice(ids, window_idx * {_L} + 1, (window_idx + 1) * {_L}) "
    f"AS input_ids, greatest(input_len - window_idx * {_L}, 0) AS lead FROM wn),\n"
    "mk AS (SELECT doc_id, window_idx, input_ids, list_transform(range(len(input_ids)), lambda x: CAST(1 AS INTEGER)) AS attention_mask, "
    f"list_concat(list_transform(range(least(lead, len(input_ids))), lambda x: {_IGN}), "
    "list_slice(input_ids, least(lead, len(input_ids)) + 1, len(input_ids))) AS labels, truncated FROM tr)\n")

ORACLE["pr_truncate_mask"] = WINDOWS + "SELECT doc_id, window_idx, input_ids, attention_mask, labels, truncated FROM mk"

ORACLE["pr_mask_audit"] = WINDOWS + (
    f"SELECT count_if(window_idx = 0) AS n_rows, count(*) AS n_windows, "
    f"count_if(len(list_filter(labels, lambda x: x <> {fixed.IGNORE_INDEX})) = 0) AS n_fully_masked, "
    "count_if(window_idx = 0 AND truncated) AS n_truncated, CAST(sum(len(input_ids)) AS BIGINT) AS n_tokens, "
    f"CAST(sum(len(list_filter(labels, lambda x: x <> {fixed.IGNORE_INDEX}))) AS BIGINT) AS n_supervised_tokens FROM mk")

# taken from the whole texts, not from windows
ORACLE["pr_token_windows"] = WINDOWS.split(",\nwn AS")[0] + (
    f"\nSELECT doc_id, greatest(CAST(ceil(len(ids) / {_L}) AS BIGINT), 1) AS n_windows, len(ids) AS n_tokens, "
    "CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS sum_ids FROM tk")


def _pad(col: str, v: int) -> str:
    return f"list_concat({col}, list_transform(range(padded_len - len({col})), lambda x: CAST({v} AS INTEGER)))"


ORACLE["pr_pad_batch"] = WINDOWS.rstrip() + (
    f",\npb AS (SELECT *, doc_id // {fixed.BATCH_SIZE} AS batch_id FROM mk),\n"
    f"pl AS (SELECT *, CAST(ceil(max(len(input_ids)) OVER (PARTITION BY batch_id, window_idx) / {fixed.PAD_MULTIPLE}) * {fixed.PAD_MULTIPLE} "
    "AS INTEGER) AS padded_len FROM pb)\n"
    f"SELECT doc_id, window_idx, batch_id, padded_len, {_pad('input_ids', fixed.PAD_TOKEN_ID)} AS padded_ids, "
    f"{_pad('attention_mask', 0)} AS padded_mask, {_pad('labels', fixed.IGNORE_INDEX)} AS padded_labels FROM pl")


def _response(text: str, marker: str) -> str:
    m = fx.duck_str(marker)
    return f"(CASE WHEN instr({text}, {m}) > 0 THEN substr({text}, instr({text}, {m}) + {len(marker)}) ELSE '' END)"


ORACLE["pr_response_mask"] = _with("examples") + (
    f"SELECT ex_id, {_response('full_text', chr(91) + 'SQL QUERY]' + chr(10))} AS response, "
    f"{_response('full_text', fixed.RESPONSE_TEMPLATE)} AS response_config_marker FROM ("
    f"SELECT ex_id, {_TRAIN_IN} || coalesce(\"SQL\", '') AS full_text FROM examples)")

_STOPS = "|".join(_re.escape(x) for x in fixed.STOP_SEQUENCES)
ORACLE["pr_stop_truncate"] = _with("predictions") + (
    f"SELECT ex_id, variant, regexp_replace(raw_answer, '(?s)({_STOPS}).*', '') AS answer_cut FROM predictions")

_S, _E = fixed.IM_START, fixed.IM_END
_NL = " || chr(10) || "
_PLAIN_HEADER = (f"(CASE WHEN first_role = 'system' THEN '{_S}system'{_NL}first_text || '{_E}' || chr(10) "
                 f"ELSE '{_S}system'{_NL}'{fixed.DEFAULT_SYSTEM}{_E}' || chr(10) END)")


def _tools_header(tools: list[str]) -> str:
    listed = "".join("\n" + x for x in tools)
    tail = fixed.TOOLS_HEADER_START + listed + fixed.TOOLS_HEADER_END + _E + "\n"
    return (f"('{_S}system'{_NL}(CASE WHEN first_role = 'system' THEN first_text ELSE '{fixed.DEFAULT_SYSTEM}' END) "
            f"|| {fx.duck_str(tail)})")


def _chat_sql(header: str, turns: str = "SELECT conv_id, turn, role, text, []::VARCHAR[] AS calls FROM conversations") -> str:
    return (
        f"WITH src AS ({turns}),\n"
        "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS c, calls, row_number() OVER w = 1 AS is_first, "
        "lag(role) OVER w AS prev, lead(role) OVER w AS nxt, first_value(role) OVER w2 AS first_role, "
        "first_value(coalesce(text, '')) OVER w2 AS first_text FROM src "
        "WINDOW w AS (PARTITION BY conv_id ORDER BY turn), "
        "w2 AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),\n"
        "p AS (SELECT conv_id, turn, "
        f"(CASE WHEN is_first THEN {header} ELSE '' END) || "
        f"(CASE WHEN role = 'assistant' AND len(calls) > 0 THEN '{_S}assistant' || (CASE WHEN c <> '' THEN chr(10) || c ELSE '' END) "
        f"|| array_to_string(calls, '') || '{_E}' || chr(10) "
        "WHEN role = 'user' OR role = 'assistant' OR (role = 'system' AND NOT is_first) THEN " f"'{_S}' || role{_NL}c || '{_E}' "
        "|| chr(10) "
        f"WHEN role = 'tool' THEN (CASE WHEN is_first OR prev <> 'tool' THEN '{_S}user' ELSE '' END){_NL}'<tool_response>'{_NL}c"
        f"{_NL}'</tool_response>' || (CASE WHEN nxt IS NULL OR nxt <> 'tool' THEN '{_E}' || chr(10) ELSE '' END) "
        "ELSE '' END) AS piece FROM t)\n"
        "SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS chat_text, count(*) AS n_turns FROM p GROUP BY conv_id")


ORACLE["pr_chat_render"] = _chat_sql(_PLAIN_HEADER)

ORACLE["pr_chat_render_tools"] = _chat_sql(_tools_header([fixed.SQL_TOOL]))

_CALL = ("chr(10) || '<tool_call>' || chr(10) || '{\"name\": \"run_sql\", \"arguments\": {\"query\": \"SELECT ' || turn || '\"}}' "
         "|| chr(10) || '</tool_call>'")
ORACLE["pr_chat_tool_runs"] = _chat_sql(_tools_header([fixed.SQL_TOOL]), (
    "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 IN (2, 3, 4) THEN 'tool' WHEN (conv_id + turn) % 6 = 1 THEN 'assistant' "
    "ELSE role END AS role, CASE WHEN (conv_id + turn) % 6 = 1 AND conv_id % 2 = 0 THEN '' ELSE text END AS text, "
    f"CASE WHEN (conv_id + turn) % 6 = 1 THEN list_transform(range(1 + conv_id % 2), lambda i: {_CALL}) ELSE []::VARCHAR[] END AS calls "
    "FROM conversations"))

# ---------------------------------------------------------------- schema cards / context
_C = fixed.MAX_CARD_COLUMNS
_CARDS = CATALOG + (
    ",\npaged AS (SELECT schema_id, CAST(pos - 1 AS INTEGER) AS table_pos, t, "
    f"CAST(unnest(range(greatest(CAST(ceil(len(t.columns) / {_C}) AS BIGINT), 1))) AS INTEGER) AS card_page "
    "FROM (SELECT schema_id, unnest(tables) AS t, generate_subscripts(tables, 1) AS pos FROM cat)),\n"
    f"shown AS (SELECT schema_id, table_pos, card_page, t.name AS table_name, list_slice(t.columns, card_page * {_C} + 1, (card_page + 1) * {_C}) "
    "AS cols FROM paged),\n"
    "cards AS (SELECT schema_id, table_pos, card_page, table_name, 'Table ' || table_name || ': ' || chr(10) || 'Columns: ' || "
    "array_to_string(list_transform(cols, lambda c: c.name), ', ') || chr(10) || array_to_string(list_transform(cols, "
    "lambda c: '  - ' || c.name || ' (' || c.type || '): '), chr(10)) AS card FROM shown)")
ORACLE["sch_schema_cards"] = _with("examples", extra=_CARDS) + "SELECT schema_id, table_pos, card_page, table_name, card FROM cards"

CONTEXT_TOKENS = 100
ORACLE["rt_context_assembly"] = _with("examples", extra=_CARDS + (
    ",\nsized AS (SELECT *, len(string_split_regex(trim(card), '\\s+')) AS n_tok FROM cards),\n"
    "run AS (SELECT *, sum(n_tok) OVER (PARTITION BY schema_id ORDER BY table_pos, card_page "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM sized),\n"
    f"ctx AS (SELECT schema_id, CAST((running - 1) // {CONTEXT_TOKENS} AS INTEGER) AS context_page, "
    "string_agg(card, chr(10) || chr(10) ORDER BY table_pos, card_page) AS context, count(*) AS n_cards, "
    "sum(n_tok) AS n_tokens FROM run GROUP BY ALL)")) + (
    "SELECT e.ex_id, coalesce(ctx.context_page, 0) AS context_page, coalesce(ctx.n_cards, 0) AS n_cards, "
    "CAST(coalesce(ctx.n_tokens, 0) AS BIGINT) AS n_tokens, coalesce(length(ctx.context), 0) AS context_chars "
    "FROM examples e LEFT JOIN ctx ON md5(coalesce(e.db_schema, '')) = ctx.schema_id")

# ---------------------------------------------------------------- sources / sinks and streaming
ORACLE["io_jsonl_roundtrip"] = _with("examples") + "SELECT ex_id, question, \"SQL\", db_schema FROM examples"
ORACLE["io_write_jsonl"] = _with("examples") + 'SELECT ex_id, db_id, question, "SQL", db_schema, query_type_name FROM examples'
ORACLE["io_prefer_source"] = _with("examples") + "SELECT ex_id, db_id FROM examples"
ORACLE["io_require_source"] = _with("examples") + (
    "SELECT coalesce(query_type_name, 'Unknown') AS label, count(*) AS n FROM examples GROUP BY 1")
ORACLE["io_tail_by_file_order"] = _with("examples") + (
    "SELECT ex_id, CASE WHEN row_number() OVER (ORDER BY ex_id DESC) <= "
    f"{fixed.DEV_SUBSET_SIZE} THEN 'dev' ELSE 'train' END AS split FROM examples")
ORACLE["st_classify_stream"] = ORACLE["cu_class_distribution"]
ORACLE["st_class_counts_stream"] = ORACLE["cu_class_distribution"]

# ---------------------------------------------------------------- documented (FK-aware) schema mode
CATALOG_DOC = ("catd AS (SELECT md5(s) AS schema_id, s, " + d.parse_schema_documented("s") +
               " AS tables FROM (SELECT DISTINCT coalesce(db_schema, '') AS s FROM examples))")

ORACLE["sch_catalog_fks"] = _with("examples", extra=CATALOG_DOC) + (
    "SELECT schema_id, CAST(pos - 1 AS INTEGER) AS table_pos, t.key AS table_key, t.name AS table_name, t.pks AS pks, "
    "len(t.columns) AS n_columns, list_transform(t.fks, lambda f: concat_ws('|', f.col, f.ref_table, f.ref_col)) AS fks "
    "FROM (SELECT schema_id, unnest(tables) AS t, generate_subscripts(tables, 1) AS pos FROM catd)")

ORACLE["sch_prune_eval_documented"] = _with("examples", extra=CATALOG_DOC.replace("catd AS", "catd AS MATERIALIZED") + (
    ",\ndpair AS MATERIALIZED (SELECT DISTINCT coalesce(question, '') AS question, coalesce(db_schema, '') AS s FROM examples),\n"
    "dtok AS MATERIALIZED (SELECT dpair.*, " + d.question_tokens("question") + " AS tok, c.tables FROM dpair JOIN catd c USING (s)),"
    + d.prune_documented_ctes("dtok", *fixed.PRUNE_EVAL))) + (
    "SELECT e.ex_id, CASE WHEN coalesce(p.text, '') = '' THEN e.db_schema ELSE p.text END AS pruned_schema FROM examples e "
    "LEFT JOIN pruned p ON coalesce(e.question, '') = p.question AND coalesce(e.db_schema, '') = p.s")

ORACLE["sch_reformat_documented"] = _with("examples", extra=(
    "rfd AS (SELECT sch, " + d.reformat_documented("sch") + " AS formatted_schema FROM (SELECT DISTINCT coalesce(db_schema, '') AS sch "
    "FROM examples))")) + (
    "SELECT e.ex_id, rfd.formatted_schema FROM examples e JOIN rfd ON coalesce(e.db_schema, '') = rfd.sch")

ORACLE["pf_config_caps"] = _with("examples") + (
    "SELECT ex_id, 'train' AS part, true AS in_head FROM examples UNION ALL "
    f"SELECT ex_id, 'eval' AS part, row_number() OVER (ORDER BY ex_id) <= {fixed.MAX_EVAL_SAMPLES} AS in_head FROM examples "
    f"WHERE {d.valid_schema('db_schema')}")

ORACLE["rt_cosine_topk"] = (
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), "
    "s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS cos FROM v q, v WHERE q.vec_id % 20 = 0) "
    "SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(cos, 6) AS similarity FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM s WHERE cos >= {fixed.SIMILARITY_THRESHOLD}) "
    f"WHERE rank <= {fixed.TOP_K}")

# ---------------------------------------------------------------- ranked context
_STOPWORDS = "[" + ", ".join(fx.duck_str(w) for w in fixed.STOPWORDS) + "]"
ORACLE["rt_ranked_context"] = _with("examples", extra=_CARDS + (
    ",\nplaced AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY schema_id ORDER BY table_pos, card_page) AS place, "
    "len(string_split_regex(trim(card), '\\s+')) AS n_tok FROM cards),\n"
    "words AS (SELECT DISTINCT schema_id, place, unnest(regexp_extract_all(replace(lower(card), '_', ' '), '[\\p{L}\\p{N}_]+')) AS token "
    "FROM placed),\n"
    f"held AS MATERIALIZED (SELECT * FROM words WHERE length(token) > 1 AND NOT list_contains({_STOPWORDS}, token)),\n"
    "weights AS (SELECT token, CAST(floor(1000 * ln((2 * (SELECT count(*) FROM placed) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w "
    "FROM held GROUP BY token),\n"
    "pairs AS MATERIALIZED (SELECT DISTINCT coalesce(question, '') AS q, md5(coalesce(db_schema, '')) AS schema_id FROM examples),\n"
    "asked AS (SELECT q, schema_id, unnest(" + d.question_tokens("q") + ") AS token FROM pairs),\n"
    "scored AS (SELECT q, schema_id, place, sum(w) AS score FROM asked JOIN held USING (schema_id, token) JOIN weights USING (token) "
    "GROUP BY ALL),\n"
    "ranked AS (SELECT p.q, schema_id, place, n_tok, table_pos, card_page, card, coalesce(score, 0) AS score, row_number() OVER "
    "(PARTITION BY p.q, schema_id ORDER BY coalesce(score, 0) DESC, place) AS rank FROM pairs p JOIN placed USING (schema_id) "
    "LEFT JOIN scored USING (q, schema_id, place)),\n"
    "running AS (SELECT *, sum(n_tok) OVER (PARTITION BY q, schema_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM ranked "
    f"WHERE rank <= {fixed.TOP_K}),\n"
    "ctx AS (SELECT q, schema_id, count(*) AS n_cards, sum(n_tok) AS context_tokens, max(score) AS best_score, "
    "string_agg(table_pos || '.' || card_page, ' ' ORDER BY rank) AS cards, string_agg(card, chr(10) || chr(10) ORDER BY rank) AS context "
    f"FROM running WHERE run <= {CONTEXT_TOKENS} OR rank = 1 GROUP BY ALL)")) + (
    "SELECT e.ex_id, coalesce(n_cards, 0) AS n_cards, CAST(coalesce(context_tokens, 0) AS BIGINT) AS context_tokens, "
    "CAST(coalesce(best_score, 0) AS BIGINT) AS best_score, coalesce(ctx.cards, '') AS cards, md5(coalesce(context, '')) AS context_md5 "
    "FROM examples e LEFT JOIN ctx ON coalesce(e.question, '') = ctx.q AND md5(coalesce(e.db_schema, '')) = ctx.schema_id")

# ---------------------------------------------------------------- selection at any size
_KEY = "md5('42|' || ex_id)"
ORACLE["cu_quota_sample"] = _with("examples") + (
    "SELECT ex_id, query_type FROM (SELECT ex_id, query_type, row_number() OVER (PARTITION BY query_type ORDER BY "
    f"{_KEY}, ex_id) AS rn, count(*) OVER (PARTITION BY query_type) AS n FROM (SELECT ex_id, " + d.classify('"SQL"') +
    " AS query_type FROM examples)) WHERE rn <= ceil(n / 10)")
ORACLE["cu_tail_share"] = _with("examples") + (
    f"SELECT ex_id, CASE WHEN row_number() OVER (ORDER BY {_KEY} DESC, ex_id DESC) <= floor(count(*) OVER () * 0.1) THEN 'dev' "
    "ELSE 'train' END AS split FROM examples")
ORACLE["io_row_number"] = _with("examples") + "SELECT ex_id, row_number() OVER (ORDER BY ex_id) AS row_number FROM examples"

# ---------------------------------------------------------------- one pass over the evaluation, stored tables
ORACLE["ev_rollup"] = _with("predictions", extra=LONG) + (
    "SELECT CASE grouping(label, variant) WHEN 0 THEN 'label' WHEN 2 THEN 'variant' ELSE 'all' END AS level, label, variant, "
    "count(*) AS total, count_if(missing) AS n_missing, count_if(correct) AS n_correct, "
    "round(count_if(correct)::DOUBLE * 100 / count(*), 6) AS pct, "
    "round(sum(CAST(round(score * 1000000) AS BIGINT))::DOUBLE / 1000000 / count(*), 6) AS mean_score "
    "FROM long GROUP BY GROUPING SETS ((label, variant), (variant), ())")
ORACLE["ev_bucketed"] = ORACLE["ev_overall_accuracy"]

ORACLE["cu_near_overlap"] = _with("examples", "targets", extra=SPLIT + (
    ",\nwords AS (SELECT ex_id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', question, \"SQL\")), '[\\p{L}\\p{N}_]+'))) AS w "
    f"FROM examples WHERE {d.valid_schema('db_schema')}),\n"
    "tr AS MATERIALIZED (SELECT DISTINCT list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', question, \"SQL\")), "
    "'[\\p{L}\\p{N}_]+'))) AS w FROM split WHERE split = 'train'),\n"
    "te AS MATERIALIZED (SELECT DISTINCT w FROM words),\n"
    "pair AS (SELECT te.w, len(list_intersect(te.w, tr.w)) AS c, len(te.w) + len(tr.w) AS s FROM te, tr WHERE len(te.w) > 0 AND len(tr.w) > 0 "
    "AND 5 * len(te.w) >= 4 * len(tr.w) AND 5 * len(tr.w) >= 4 * len(te.w)),\n"
    "near AS (SELECT w, count(*) AS n, max(c::DOUBLE / (s - c)) AS j FROM pair WHERE 5 * c >= 4 * (s - c) GROUP BY w)")) + (
    "SELECT ex_id, coalesce(n, 0) AS n_near, round(coalesce(j, 0.0), 6) AS similarity FROM words LEFT JOIN near USING (w)")

ORACLE["io_rejects"] = _with("examples") + (
    "SELECT kind, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, count(*) AS n_counted FROM ("
    "SELECT CASE WHEN ex_id % 5 = 0 THEN 'malformed' ELSE 'record' END AS kind, CASE WHEN ex_id % 5 = 0 THEN 9 ELSE ex_id END AS v FROM examples "
    "UNION ALL SELECT 'blank', 2 FROM examples WHERE ex_id % 3 = 0 UNION ALL SELECT 'comment', 7 FROM examples WHERE ex_id % 3 = 1) GROUP BY kind")

# ---------------------------------------------------------------- large catalogs, sketches, pruning on a stream
_PRUNED_DOC = CATALOG_DOC.replace("catd AS", "catd AS MATERIALIZED") + (
    ",\ndpair AS MATERIALIZED (SELECT DISTINCT coalesce(question, '') AS question, coalesce(db_schema, '') AS s FROM examples),\n"
    "dtok AS MATERIALIZED (SELECT dpair.*, " + d.question_tokens("question") + " AS tok, c.tables FROM dpair JOIN catd c USING (s)),"
    + d.prune_documented_ctes("dtok", *fixed.PRUNE_EVAL))

ORACLE["sch_fk_closure"] = _with("examples", extra=_PRUNED_DOC) + (
    "SELECT md5(s) AS schema_id, md5(question) AS question_md5, table_key, CASE WHEN list_contains(matched, table_key) THEN 'matched' "
    "WHEN list_contains(step2, table_key) THEN 'referenced' WHEN list_contains(step3, table_key) THEN 'referencing' ELSE 'added' END AS step "
    "FROM (SELECT question, s, unnest(selected) AS table_key FROM d4) JOIN d3 USING (question, s)")

ORACLE["ev_score_sketch"] = _with("predictions", extra=LONG) + (
    "SELECT variant, label, count(*) AS n, min(score) AS min_score, max(score) AS max_score, true AS median_within, true AS p90_within "
    "FROM long GROUP BY variant, label")

ORACLE["st_prune_stream"] = _with("examples", extra=_PRUNED_DOC + (
    ",\nshown AS (SELECT e.ex_id, e.question, CASE WHEN coalesce(p.text, '') = '' THEN e.db_schema ELSE p.text END AS pruned_schema "
    "FROM examples e LEFT JOIN pruned p ON coalesce(e.question, '') = p.question AND coalesce(e.db_schema, '') = p.s)")) + (
    "SELECT ex_id, pruned_schema, md5(" + fx.duck_eval_prompt("question", "pruned_schema") + ") AS prompt_md5 FROM shown")
