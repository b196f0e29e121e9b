"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each reads the driver tables (or fixtures Spark derives from them) in full.
Set-valued columns are returned as sorted arrays so results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.classify import classify_query_type
from tessera.functions.sqltext import FEATURES, near_correct, semantic_score, with_sql_features
from tessera.operators import curate, evaluate as ev
from tessera.session import scratch_path
from tessera.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- classification
@query("cl_classify_examples")
def cl_classify_examples(spark, sf):
    return fx.examples(spark, sf).select("ex_id", classify_query_type(F.col("SQL")).alias("query_type"))


@query("cu_class_distribution")
def cu_class_distribution(spark, sf):
    return curate.class_distribution(curate.with_query_type(fx.examples(spark, sf)))


# ---------------------------------------------------------------- curation
@query("cu_stratified_sample")
def cu_stratified_sample(spark, sf):
    c = curate.with_query_type(fx.examples(spark, sf))
    return curate.stratified_sample(c, spark).select("ex_id", "query_type", "rn")


@query("cu_class_deficit")
def cu_class_deficit(spark, sf):
    c = curate.with_query_type(fx.examples(spark, sf))
    return curate.class_deficit(c, spark).select("query_type", "target", "available", "deficit")


@query("cu_synthetic_rows")
def cu_synthetic_rows(spark, sf):
    c = curate.with_query_type(fx.examples(spark, sf))
    return curate.synthetic_rows(curate.class_deficit(c, spark), spark)


@query("cu_balanced_dataset")
def cu_balanced_dataset(spark, sf):
    return curate.shuffled(curate.balanced_dataset(fx.examples(spark, sf), spark))


@query("cu_target_check")
def cu_target_check(spark, sf):
    return curate.target_check(curate.balanced_dataset(fx.examples(spark, sf), spark), spark)


def _split(spark, sf) -> DataFrame:
    # The balanced set is a product of its own (written once, then split and
    # probed several times): it is written as a table under the cluster's
    # spark.checkpoint.dir and read back, which computes it once and cuts the
    # lineage (Dataset.checkpoint would run the plan twice).
    path = scratch_path(spark, "balanced")
    curate.balanced_dataset(fx.examples(spark, sf), spark).write.mode("overwrite").parquet(path)
    return curate.tail_split(spark.read.parquet(path), ["shuffle_key", "row_key"], "row_key")


@query("cu_tail_split")
def cu_tail_split(spark, sf):
    return _split(spark, sf).select("row_key", "split")


@query("cu_dataset_report")
def cu_dataset_report(spark, sf):
    return curate.dataset_report(_split(spark, sf))


@query("cu_overlap_check")
def cu_overlap_check(spark, sf):
    ex = fx.examples(spark, sf)
    test = ex.filter(ev.valid_schema(F.col("db_schema")))
    train = _split(spark, sf).filter(F.col("split") == "train")
    return curate.overlap_check(test, train)


# ---------------------------------------------------------------- SQL features / scoring
@query("sc_sql_features")
def sc_sql_features(spark, sf):
    p = with_sql_features(fx.predictions(spark, sf), "raw_answer", "f")
    return p.select("ex_id", "variant", *[F.sort_array(F.col("f")[k]).alias(k) for k in FEATURES])


@query("sc_semantic_score")
def sc_semantic_score(spark, sf):
    # One row per example meets its answers; its own features are taken once,
    # after the join and before the answers are spread out.  Features take far
    # longer than their texts' bytes suggest, by which AQE would merge
    # partitions: a number that is asked for stays.
    ex = fx.examples(spark, sf).select("ex_id", F.col("SQL").alias("gt_sql"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    answers = fx.predictions(spark, sf).repartition(parts, "ex_id").groupBy("ex_id").agg(F.collect_list(F.struct("variant", "raw_answer")).alias("a"))  # one per variant
    j = with_sql_features(ex.hint("merge").join(answers, "ex_id"), "gt_sql", "gt_f")
    j = with_sql_features(j.select("ex_id", "gt_f", F.explode("a").alias("a")).select("ex_id", "gt_f", "a.*"), "raw_answer", "p_f")
    s = j.select("ex_id", "variant", semantic_score(F.col("p_f"), F.col("gt_f")).alias("s"))
    return s.select("ex_id", "variant", F.round("s", 6).alias("score"), near_correct(F.col("s")).alias("near_correct"))


# ---------------------------------------------------------------- evaluation
def _long(spark, sf) -> DataFrame:
    ex = fx.examples(spark, sf)
    return ev.evaluate(ex, fx.predictions_from(ex), mode="observed")


@query("ev_missing_predictions")
def ev_missing_predictions(spark, sf):
    """A rule on the key drops some predictions: some examples lack one variant, some all."""
    ex = fx.examples(spark, sf)
    have = fx.predictions_from(ex).filter((F.col("ex_id") % 4 != 1) & ~((F.col("ex_id") % 4 == 2) & (F.col("variant") == "base")))
    return ev.overall_accuracy(ev.wide_results(ev.evaluate(ex, have, mode="observed")))


@query("pf_valid_schema")
def pf_valid_schema(spark, sf):
    return fx.examples(spark, sf).filter(ev.valid_schema(F.col("db_schema"))).select("ex_id", "db_id")


@query("pf_head_n")
def pf_head_n(spark, sf):
    ex = fx.examples(spark, sf).filter(ev.valid_schema(F.col("db_schema")))
    return ev.in_head(ex, "ex_id", fixed.MAX_TEST_SAMPLES).select(
        "ex_id", F.coalesce("query_type_name", F.lit("Unknown")).alias("label"), "in_head")


@query("ev_evaluate")
def ev_evaluate(spark, sf):
    return _long(spark, sf)


@query("ev_results_wide")
def ev_results_wide(spark, sf):
    return ev.wide_results(_long(spark, sf))


@query("ev_accuracy_by_type")
def ev_accuracy_by_type(spark, sf):
    return ev.accuracy_by_type(ev.wide_results(_long(spark, sf)))


@query("ev_overall_accuracy")
def ev_overall_accuracy(spark, sf):
    return ev.overall_accuracy(ev.wide_results(_long(spark, sf)))


@query("ev_category_wins")
def ev_category_wins(spark, sf):
    return ev.category_wins(ev.accuracy_by_type(ev.wide_results(_long(spark, sf))))


@query("ev_score_distribution")
def ev_score_distribution(spark, sf):
    return ev.score_distribution(_long(spark, sf))


# ---------------------------------------------------------------- workload classes on the star schema
from tessera.plans.workload import WORKLOAD  # noqa: E402

QUERIES.update(WORKLOAD)


# ---------------------------------------------------------------- schema text
from tessera.functions.schema_text import question_tokens  # noqa: E402
from tessera.operators import schema_ops  # noqa: E402
from tessera.sources.tables import table  # noqa: E402


@query("sch_question_tokens")
def sch_question_tokens(spark, sf):
    return fx.examples(spark, sf).select("ex_id", F.sort_array(question_tokens(F.col("question"))).alias("tokens"))


@query("sch_document_tokens")
def sch_document_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.sort_array(question_tokens(F.col("text"))).alias("tokens"))


@query("sch_catalog_tables")
def sch_catalog_tables(spark, sf):
    return schema_ops.catalog_tables(schema_ops.parsed_catalog(fx.examples(spark, sf), mode="observed"))


@query("sch_catalog_columns")
def sch_catalog_columns(spark, sf):
    return schema_ops.catalog_columns(schema_ops.parsed_catalog(fx.examples(spark, sf), mode="observed"))


@query("sch_prune_eval")
def sch_prune_eval(spark, sf):
    mt, mc = fixed.PRUNE_EVAL
    return schema_ops.prune_schemas(fx.examples(spark, sf), mt, mc, mode="observed").select("ex_id", "pruned_schema")


@query("sch_prune_train")
def sch_prune_train(spark, sf):
    mt, mc = fixed.PRUNE_TRAIN
    return schema_ops.prune_schemas(fx.examples(spark, sf), mt, mc, mode="observed").select("ex_id", "pruned_schema")


@query("sch_prune_dataset_report")
def sch_prune_dataset_report(spark, sf):
    mt, mc = fixed.PRUNE_TRAIN
    return schema_ops.prune_dataset_report(
        schema_ops.prune_schemas(fx.examples(spark, sf), mt, mc, mode="observed"))


@query("sch_reformat")
def sch_reformat(spark, sf):
    return schema_ops.reformat_schemas(fx.examples(spark, sf), mode="observed").select("ex_id", "formatted_schema")


# ---------------------------------------------------------------- prompts, model inputs, chat
from tessera.functions.prompts import response_part, stop_truncate  # noqa: E402
from tessera.functions.schema_text import WORD_RUN  # noqa: E402
from tessera.operators import chat, model_inputs as mi  # noqa: E402

TRAIN_MARKER = "[SQL QUERY]\n"


@query("pr_train_prompt")
def pr_train_prompt(spark, sf):
    return mi.training_examples(fx.examples(spark, sf)).select("ex_id", "input", "output", "full_text")


@query("pr_train_prompt_pruned")
def pr_train_prompt_pruned(spark, sf):
    return mi.training_examples(fx.examples(spark, sf), prune=fixed.PRUNE_TRAIN, mode="observed").select("ex_id", "input")


@query("pr_eval_prompts")
def pr_eval_prompts(spark, sf):
    ex = fx.examples(spark, sf).filter(ev.valid_schema(F.col("db_schema")))
    return mi.variant_prompts(ex, mode="observed").select("ex_id", "variant", "prompt")


def token_rows(spark, sf) -> DataFrame:
    """doc_id, ids (word lengths of the whole text), input_len (three quarters of them)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    ids = F.transform(F.regexp_extract_all("text", F.lit(WORD_RUN), 0), lambda w: F.length(w))
    return d.select("doc_id", ids.alias("ids")).withColumn("input_len", (F.size("ids") * 3 / 4).cast("int"))


def _windows(spark, sf) -> DataFrame:
    return mi.token_windows(token_rows(spark, sf))


@query("pr_truncate_mask")
def pr_truncate_mask(spark, sf):
    """Every window of every document; window 0 is the original's truncated input."""
    return _windows(spark, sf).select("doc_id", "window_idx", "input_ids", "attention_mask", "labels", "truncated")


@query("pr_mask_audit")
def pr_mask_audit(spark, sf):
    return mi.mask_audit(_windows(spark, sf))


@query("pr_token_windows")
def pr_token_windows(spark, sf):
    """Ids and windows of each document: nothing is cut off."""
    return _windows(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum(F.size("input_ids")).alias("n_tokens"),
        F.sum(F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x)).alias("sum_ids"))


@query("pr_pad_batch")
def pr_pad_batch(spark, sf):
    m = _windows(spark, sf).withColumn("batch_id", (F.col("doc_id") / fixed.BATCH_SIZE).cast("long"))
    batched = m.withColumn("batch_id", F.struct("batch_id", "window_idx"))
    return mi.pad_batches(batched, "batch_id").select(
        "doc_id", "window_idx", F.col("batch_id.batch_id").alias("batch_id"), "padded_len", "padded_ids", "padded_mask",
        "padded_labels")


@query("pr_response_mask")
def pr_response_mask(spark, sf):
    t = mi.training_examples(fx.examples(spark, sf))
    return t.select("ex_id", response_part(F.col("full_text"), TRAIN_MARKER).alias("response"),
                    response_part(F.col("full_text")).alias("response_config_marker"))


@query("pr_stop_truncate")
def pr_stop_truncate(spark, sf):
    return fx.predictions(spark, sf).select("ex_id", "variant", stop_truncate(F.col("raw_answer")).alias("answer_cut"))


@query("pr_chat_render")
def pr_chat_render(spark, sf):
    return chat.render_chat(table(spark, sf, "conversations"))


# ---------------------------------------------------------------- schema cards / context assembly
@query("sch_schema_cards")
def sch_schema_cards(spark, sf):
    return schema_ops.schema_cards(schema_ops.parsed_catalog(fx.examples(spark, sf), mode="observed"))


#: A budget that the wider schemas of the test corpus exceed, so that further pages occur.
CONTEXT_TOKENS = 100


@query("rt_context_assembly")
def rt_context_assembly(spark, sf):
    ex = fx.examples(spark, sf)
    ctx = schema_ops.assemble_context(schema_ops.schema_cards(schema_ops.parsed_catalog(ex, mode="observed")), CONTEXT_TOKENS)
    return schema_ops.attach_context(ex, ctx).select(
        "ex_id", "context_page", "n_cards", "n_tokens", F.length("context").alias("context_chars"))


# ---------------------------------------------------------------- sources / sinks and streaming
from tessera.session import scratch_path  # noqa: E402
from tessera.sources import jsonl  # noqa: E402
from tessera.streaming import stateless  # noqa: E402


@query("io_jsonl_roundtrip")
def io_jsonl_roundtrip(spark, sf):
    """Write the examples as JSON lines (some with a lower-case ``sql`` key,
    plus blank and comment lines), read them back, and return the fields."""
    ex = fx.examples(spark, sf)
    upper = F.to_json(F.struct("ex_id", "db_id", "question", "SQL", "db_schema"))
    lower = F.to_json(F.struct("ex_id", "db_id", "question", F.col("SQL").alias("sql"), "db_schema"))
    record = F.when(F.col("ex_id") % 7 == 0, lower).otherwise(upper)
    # every example becomes three lines: its record, a blank line and a comment line
    lines = ex.select(F.explode(F.array(record, F.lit("   "),
                                        F.concat(F.lit("# note "), F.col("ex_id").cast("string")))).alias("value"))
    path = scratch_path(spark, "jsonl")
    lines.write.mode("overwrite").text(path)
    back = jsonl.read_jsonl(spark, path, skip_comments=True)
    return back.select(F.col("ex_id").cast("long").alias("ex_id"), "question", "SQL", "db_schema")


def _stream_source(spark, sf) -> tuple[str, object]:
    ex = fx.examples(spark, sf)
    src = scratch_path(spark, "stream-src")
    ex.write.mode("overwrite").parquet(src)
    return src, ex.schema


@query("st_classify_stream")
def st_classify_stream(spark, sf):
    src, schema = _stream_source(spark, sf)
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    stateless.classify_stream(spark, src, schema, sink, ckpt).awaitTermination()
    return curate.class_distribution(spark.read.parquet(sink))


@query("st_class_counts_stream")
def st_class_counts_stream(spark, sf):
    src, schema = _stream_source(spark, sf)
    out, ckpt = scratch_path(spark, "stream-counts"), scratch_path(spark, "stream-ckpt")
    stateless.class_counts_stream(spark, src, schema, out, ckpt).awaitTermination()
    return stateless.latest(spark, out).select("query_type", "n")


# ---------------------------------------------------------------- documented (FK-aware) schema mode
@query("sch_catalog_fks")
def sch_catalog_fks(spark, sf):
    cat = schema_ops.parsed_catalog(fx.examples(spark, sf), mode="documented")
    fk_text = lambda f: F.concat_ws("|", f["col"], f["ref_table"], f["ref_col"])
    return schema_ops._tables_exploded(cat).select(
        "schema_id", "table_pos", F.col("t.key").alias("table_key"), F.col("t.name").alias("table_name"),
        F.col("t.pks").alias("pks"), F.size("t.columns").alias("n_columns"), F.transform("t.fks", fk_text).alias("fks"))


@query("sch_prune_eval_documented")
def sch_prune_eval_documented(spark, sf):
    mt, mc = fixed.PRUNE_EVAL
    return schema_ops.prune_schemas(fx.examples(spark, sf), mt, mc, mode="documented").select("ex_id", "pruned_schema")


@query("sch_reformat_documented")
def sch_reformat_documented(spark, sf):
    return schema_ops.reformat_schemas(fx.examples(spark, sf), mode="documented").select("ex_id", "formatted_schema")


@query("pr_chat_render_tools")
def pr_chat_render_tools(spark, sf):
    return chat.render_chat(table(spark, sf, "conversations"), tools=[fixed.SQL_TOOL])


def tool_turns(spark, sf) -> DataFrame:
    """Conversations with tool turns and calls, by a rule on the turn: of six
    turns in a row the third and fourth, or the fifth, answer a tool; the
    assistant's turns before them call it once or twice."""
    step = (F.col("conv_id") + F.col("turn")) % 6
    call = F.struct(F.lit("run_sql").alias("name"),
                    F.concat(F.lit('{"query": "SELECT '), F.col("turn").cast("string"), F.lit('"}')).alias("arguments"))
    none = F.array().cast("array<struct<name:string,arguments:string>>")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(step.isin(2, 3, 4), "tool").when(step == 1, "assistant").otherwise(F.col("role")).alias("role"),
        F.when((step == 1) & (F.col("conv_id") % 2 == 0), F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(step == 1, F.array_repeat(call, (1 + F.col("conv_id") % 2).cast("int"))).otherwise(none).alias("calls"))


@query("pr_chat_tool_runs")
def pr_chat_tool_runs(spark, sf):
    return chat.render_chat(tool_turns(spark, sf), tools=[fixed.SQL_TOOL], tool_calls="calls")


@query("pf_config_caps")
def pf_config_caps(spark, sf):
    ex = fx.examples(spark, sf)
    train = ev.in_head(ex, "ex_id", fixed.MAX_TRAIN_SAMPLES).select("ex_id", F.lit("train").alias("part"), "in_head")
    evals = ev.in_head(ex.filter(ev.valid_schema(F.col("db_schema"))), "ex_id", fixed.MAX_EVAL_SAMPLES) \
        .select("ex_id", F.lit("eval").alias("part"), "in_head")
    return train.unionByName(evals)


# ---------------------------------------------------------------- further sources / sinks
def _written_examples(spark, sf, name: str) -> str:
    path = scratch_path(spark, name)
    jsonl.write_jsonl(fx.examples(spark, sf), path)
    return path


@query("io_write_jsonl")
def io_write_jsonl(spark, sf):
    """The sink's lines, parsed by Spark's own JSON reader."""
    lines = spark.read.text(_written_examples(spark, sf, "written"))
    return lines.select(F.from_json("value", "ex_id long, db_id string, question string, `SQL` string, db_schema string, "
                                             "query_type_name string").alias("r")).select("r.*")


@query("io_prefer_source")
def io_prefer_source(spark, sf):
    missing, present = scratch_path(spark, "missing"), _written_examples(spark, sf, "preferred")
    got = jsonl.prefer_source(spark, [missing, present]).select(F.col("ex_id").cast("long").alias("ex_id"), "db_id")
    none = jsonl.prefer_source(spark, [missing]).select(F.col("ex_id").cast("long").alias("ex_id"), "db_id")
    return got.unionByName(none)


@query("io_require_source")
def io_require_source(spark, sf):
    """Label counts of a required file; a path that is not there must fail."""
    try:
        jsonl.require_source(spark, scratch_path(spark, "missing"))
        raise AssertionError("a missing source was read")
    except FileNotFoundError:
        pass
    rows = jsonl.require_source(spark, _written_examples(spark, sf, "required"))
    return rows.groupBy(F.coalesce("query_type_name", F.lit("Unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("io_report")
def io_report(spark, sf):
    """The summary line of the evaluation report, without its time."""
    wide = ev.wide_results(_long(spark, sf))
    overall = ev.overall_accuracy(wide)
    metadata = jsonl.report_metadata(0, fixed.PRUNE_EVAL, {"base": "b"})
    line = jsonl.report_summary(overall, metadata, ev.VARIANT_NAMES)
    get = lambda path, kind: F.try_variant_get(F.parse_json("value"), path, kind)
    return line.select(
        *[get(f"$.overall_accuracy.{v}", "double").alias(v) for v in ev.VARIANT_NAMES],
        get("$.pruning_comparison.difference", "double").alias("difference"),
        get("$.pruning_comparison.pruning_helps", "long").alias("pruning_helps"),
        get("$.pruning_comparison.pruning_hurts", "long").alias("pruning_hurts"),
        get("$.n_missing", "long").alias("n_missing"),
        get("$.metadata.schema_pruning.max_columns", "long").alias("max_columns"))


@query("io_tail_by_file_order")
def io_tail_by_file_order(spark, sf):
    """Train/dev split by place in the file: examples written in key order to
    one file per range of keys, the last rows of the last file are dev."""
    path = scratch_path(spark, "ordered")
    fx.examples(spark, sf).repartitionByRange("ex_id").sortWithinPartitions("ex_id") \
        .select(F.to_json(F.struct("ex_id", "question")).alias("value")).write.text(path)
    rows = jsonl.read_jsonl(spark, path, fields=["ex_id"])
    return curate.tail_split(rows, ["ord"], "ord").select(F.col("ex_id").cast("long").alias("ex_id"), "split")


# ---------------------------------------------------------------- retrieval
@query("rt_cosine_topk")
def rt_cosine_topk(spark, sf):
    """The vectors whose id is divisible by 20 against all vectors."""
    from tessera.operators.retrieve import cosine_top_k_of
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return cosine_top_k_of(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query("rt_ranked_context")
def rt_ranked_context(spark, sf):
    """The best cards of each question within a budget that some exceed."""
    from tessera.operators.ranked_context import ranked_context
    ex = fx.examples(spark, sf)
    cards = schema_ops.schema_cards(schema_ops.parsed_catalog(ex, mode="observed"))
    return ranked_context(ex, cards, budget=CONTEXT_TOKENS).select(
        "ex_id", "n_cards", "context_tokens", "best_score", "cards", F.md5("context").alias("context_md5"))


# ---------------------------------------------------------------- selection at any size
from tessera.operators import selection  # noqa: E402


@query("cu_quota_sample")
def cu_quota_sample(spark, sf):
    """A tenth of every class, rounded up, by seeded order."""
    c = curate.with_query_type(fx.examples(spark, sf)).select("ex_id", "query_type")
    return selection.quota_sample(c, F.ceil(F.col("n") / 10), curate.sample_key(F.col("ex_id")))


@query("cu_tail_share")
def cu_tail_share(spark, sf):
    """The last tenth of the examples by seeded order is dev."""
    ex = fx.examples(spark, sf).select("ex_id", curate.sample_key(F.col("ex_id")).alias("shuffle_key"))
    return selection.tail_share(ex, ["shuffle_key", "ex_id"], 0.1).select("ex_id", "split")


@query("io_row_number")
def io_row_number(spark, sf):
    """Dense numbers in file order of examples written in key order, a blank
    line after each."""
    path = scratch_path(spark, "numbered")
    fx.examples(spark, sf).repartitionByRange("ex_id").sortWithinPartitions("ex_id") \
        .select(F.explode(F.array(F.to_json(F.struct("ex_id")), F.lit(""))).alias("value")).write.text(path)
    rows = jsonl.read_jsonl(spark, path, fields=["ex_id"])
    return selection.with_row_number(rows, F.col("ord.file"), F.col("ord.split")).select(
        F.col("ex_id").cast("long").alias("ex_id"), "row_number")


@query("ev_rollup")
def ev_rollup(spark, sf):
    return ev.accuracy_rollup(_long(spark, sf))


BUCKETS = 16


@query("ev_bucketed")
def ev_bucketed(spark, sf):
    """Overall accuracy from stored tables that share their buckets."""
    import uuid
    ex = fx.examples(spark, sf)
    run = uuid.uuid4().hex[:12]
    stored = lambda df, name: ev.write_bucketed(df, f"{name}_{run}", scratch_path(spark, name), BUCKETS)
    samples = stored(ev.prompt_lengths(ex.filter(ev.valid_schema(F.col("db_schema"))), mode="observed"), "samples")
    predictions = stored(fx.predictions_from(ex), "predictions")
    return ev.overall_accuracy(ev.wide_results(ev.evaluate(None, predictions, samples=samples)))


@query("cu_near_overlap")
def cu_near_overlap(spark, sf):
    """Test examples against the training set: question and SQL together share
    four fifths of their words."""
    from tessera.operators.near_overlap import near_overlap
    test = fx.examples(spark, sf).filter(ev.valid_schema(F.col("db_schema")))
    return near_overlap(test, _split(spark, sf).filter(F.col("split") == "train"), "question", "SQL")


@query("io_rejects")
def io_rejects(spark, sf):
    """Lines of each kind, from the tables and as counted while they passed;
    each example is a record, or by a rule on its key a broken line, with a
    blank or a comment line after some."""
    ex = fx.examples(spark, sf)
    record = F.to_json(F.struct("ex_id", "question"))
    line = F.when(F.col("ex_id") % 5 == 0, F.left(record, F.lit(9))).otherwise(record)
    after = F.when(F.col("ex_id") % 3 == 0, F.array(F.lit("  "))).when(F.col("ex_id") % 3 == 1, F.array(F.lit(" # note")))
    lines = ex.select(F.explode(F.concat(F.array(line), F.coalesce(after, F.array().cast("array<string>")))).alias("value"))
    path = scratch_path(spark, "mixed-lines")
    lines.write.text(path)
    records, rejects, counts = jsonl.read_with_rejects(spark, path, fields=["ex_id"])
    found = records.select(F.lit("record").alias("kind"), F.col("ex_id").cast("long").alias("v")).unionByName(
        rejects.select("kind", F.length("value").cast("long").alias("v")))
    counted = F.create_map(*(F.lit(x) for kv in counts.items() for x in kv))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")) \
        .withColumn("n_counted", counted[F.col("kind")])


@query("sch_fk_closure")
def sch_fk_closure(spark, sf):
    """The tables that each distinct question over a schema needs, by joins."""
    from tessera.operators import fk_closure
    ex = fx.examples(spark, sf)
    path = scratch_path(spark, "schema-catalog")
    schema_ops.parsed_catalog(ex, mode="documented").select("schema_id", "tables").write.parquet(path)
    catalog = spark.read.parquet(path)
    pairs = fk_closure.question_pairs(ex)
    selected = fk_closure.select_tables(pairs, fk_closure.table_rows(catalog), fk_closure.edge_rows(catalog), fixed.PRUNE_EVAL[0])
    return selected.join(pairs.select("pair", F.md5("question").alias("question_md5")).hint("merge"), "pair") \
        .select("schema_id", "question_md5", "table_key", "step")


@query("ev_score_sketch")
def ev_score_sketch(spark, sf):
    """Sketches of two runs (by a rule on the key), stored and merged, and
    whether the merged quantiles keep their bound."""
    from tessera.operators import score_sketch as sk
    path = scratch_path(spark, "scores")
    _long(spark, sf).select((F.col("ex_id") % 2).alias("run"), "variant", "label", "score").write.parquet(path)
    scores, runs = spark.read.parquet(path), scratch_path(spark, "score-sketches")
    sk.score_sketches(scores, "run").write.partitionBy("run").parquet(runs)
    found = sk.sketch_quantiles(sk.merge_score_sketches(spark.read.parquet(runs)), min_score=0, median=0.5, p90=0.9, max_score=1)
    for name, q in (("median", 0.5), ("p90", 0.9)):
        errors = sk.rank_errors(scores, found, name, q)
        found = found.join(errors.select("variant", "label", (F.col("rank_error") <= sk.RANK_ERROR).alias(f"{name}_within")),
                           ["variant", "label"])
    return found.select("variant", "label", "n", "min_score", "max_score", "median_within", "p90_within")


@query("st_prune_stream")
def st_prune_stream(spark, sf):
    """Examples that arrive in three parts, each taken up by a query started
    anew from the checkpoint."""
    from tessera.streaming import schema_stream
    ex = fx.examples(spark, sf)
    src, out, catalog, ckpt = (scratch_path(spark, f"prune-{n}") for n in ("src", "out", "catalog", "ckpt"))
    for part in range(3):
        ex.filter(F.col("ex_id") % 3 == part).write.mode("append").parquet(src)
        schema_stream.prune_stream(spark, src, ex.schema, out, catalog, ckpt).awaitTermination()
    return schema_stream.read_epochs(spark, out).select("ex_id", "pruned_schema", F.md5("prompt").alias("prompt_md5"))
