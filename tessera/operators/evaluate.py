"""Evaluation: attach predictions, clean answers, match, score, report.

Predictions are an input table (ex_id, variant, raw_answer).  Each side is
brought to one row per ``ex_id`` by an aggregate on it, and the left join of
examples with predictions reuses that partitioning, as does the per-sample pivot
(``groupBy(ex_id, label)``): both inputs are shuffled once.  It is a sort-merge
join, which spills and whose frequent keys adaptive execution splits.  Every
example gets a row per variant; a prediction that is missing counts as wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.prompts import eval_prompt_len
from tessera.functions.sqltext import (
    extract_sql_answer, match_form, near_correct, semantic_score, strip_prompt_echo, with_sql_features,
)
from tessera.functions.text import group_label, strip
from tessera.operators.schema_ops import MODE, prune_schemas

VARIANT_NAMES = [v for v, _ in fixed.VARIANTS]
VARIANT_LABELS = dict(fixed.VARIANTS)
BEST_MODEL_LABELS = {
    "base": "Base", "finetuned_no_prune": "Fine-tuned (No Prune)",
    "finetuned_prune": "Fine-tuned (Prune)", "llama": "Llama3",
}


def valid_schema(schema: Column) -> Column:
    """Non-empty, not the placeholder, stripped length > 10 (O-PF-3)."""
    s = F.coalesce(schema, F.lit(""))
    return (F.length(s) > 0) & (s != fixed.SCHEMA_NOT_AVAILABLE) & (F.length(strip(s)) > fixed.MIN_SCHEMA_LEN)


def head_n(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """First ``n`` rows in file order (O-PF-5): a TakeOrderedAndProject.  The
    limit is the operator; evaluation itself takes all rows."""
    return df.orderBy(order_col).limit(n)


def in_head(df: DataFrame, key: str, n: int | None, out: str = "in_head") -> DataFrame:
    """Every row, with whether it is among the first ``n`` by ``key`` (all of
    them when ``n`` is None, O-PF-6).  Only the n-th key is looked up, once."""
    if n is None:
        return df.withColumn(out, F.lit(True))
    last = head_n(df.select(key), key, n).agg(F.max(key).alias("last")).scalar()
    return df.withColumn(out, F.coalesce(F.col(key) <= last, F.lit(False)))


def answer_status(variant: Column, answer: Column, match: Column) -> Column:
    """Tri-state correctness (O-PF-4): SKIPPED -> null for the fine-tuned
    variants, ERROR -> null for llama only; other errors count as wrong."""
    skipped = variant.isin("finetuned_no_prune", "finetuned_prune") & answer.startswith("SKIPPED")
    errored = (variant == "llama") & answer.startswith("ERROR")
    return F.when(skipped | errored, F.lit(None).cast("boolean")).otherwise(match)


def prompt_lengths(examples: DataFrame, prune: tuple[int, int] = fixed.PRUNE_EVAL, mode: str = MODE) -> DataFrame:
    """ex_id, label, gt_sql and the lengths of the prompts the variants saw.

    This is what evaluation needs of the examples; the job that renders prompts
    can store it, so that evaluation need not prune again.
    """
    p = prune_schemas(examples, prune[0], prune[1], mode=mode)
    has_both = (F.coalesce(F.length("db_schema"), F.lit(0)) > 0) & (F.coalesce(F.length("question"), F.lit(0)) > 0)
    full = eval_prompt_len(F.col("question"), F.col("db_schema"))
    return p.select("ex_id", group_label(examples.columns).alias("label"), F.col("SQL").alias("gt_sql"),
                    full.alias("prompt_len"),
                    F.when(has_both, eval_prompt_len(F.col("question"), F.col("pruned_schema"))).otherwise(full)
                    .alias("pruned_prompt_len"))


def _one_row_per_example(samples: DataFrame) -> DataFrame:
    """``samples`` keyed by a present, unique ex_id, or an error."""
    error = F.concat(F.lit("evaluation needs a unique ex_id: "), F.coalesce(F.col("ex_id").cast("string"), F.lit("null")),
                     F.lit(" occurs "), F.col("_n").cast("string"), F.lit(" times"))
    kind = samples.schema["ex_id"].dataType
    rest = [c for c in samples.columns if c != "ex_id"]
    g = samples.groupBy("ex_id").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    fine = (F.col("_n") == 1) & F.col("ex_id").isNotNull()
    return g.withColumn("gt_sql", F.when(fine, F.col("gt_sql")).otherwise(F.raise_error(error).cast("string"))) \
        .select(F.col("ex_id").cast(kind).alias("ex_id"), *rest)


def evaluate(examples: DataFrame, predictions: DataFrame, only_valid: bool = True,
             prune: tuple[int, int] = fixed.PRUNE_EVAL, mode: str = MODE, samples: DataFrame | None = None) -> DataFrame:
    """Long result: ex_id, label, variant, answer, missing, correct, score,
    near_correct (O-EV-7), one row per example and variant.

    A local model's response echoes its prompt, which is dropped by length:
    the full-schema prompt for base / finetuned_no_prune, the pruned-schema
    prompt for finetuned_prune (when schema and question are both present).
    ``samples``: stored ``prompt_lengths`` of the examples to evaluate; they
    are computed here when absent.  A missing prediction has no answer, is
    wrong, and scores 0.  An ex_id that is null or occurs twice is an error, as
    is a second prediction of a variant for it.
    """
    if samples is None:
        ex = examples.filter(valid_schema(F.col("db_schema"))) if only_valid else examples
        samples = prompt_lengths(ex, prune, mode)
    raw = {v: F.when(F.col("variant") == v, F.col("raw_answer")) for v in VARIANT_NAMES}
    twice = [F.when(F.count_if(F.col("variant") == v) > 1,
                    F.raise_error(F.concat(F.lit(f"two predictions of {v} for ex_id "), F.col("ex_id").cast("string")))
                    .cast("string")).otherwise(F.max(raw[v])).alias(v) for v in VARIANT_NAMES]
    answers = predictions.groupBy("ex_id").agg(*twice)
    j = with_sql_features(_one_row_per_example(samples), "gt_sql", "gt_f").join(answers.hint("merge"), "ex_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("raw_answer")) for v in VARIANT_NAMES]))
    j = j.select("ex_id", "label", match_form(F.col("gt_sql")).alias("gt_form"), "gt_f", "prompt_len", "pruned_prompt_len", each.alias("p")) \
        .select("*", "p.variant", "p.raw_answer")
    plen = F.when(F.col("variant") == "finetuned_prune", F.col("pruned_prompt_len")).otherwise(F.col("prompt_len"))
    local = F.col("variant") != "llama"
    response = F.when(local, strip_prompt_echo(F.col("raw_answer"), plen)).otherwise(F.col("raw_answer"))
    answered = j.select("ex_id", "label", "variant", "gt_form", "gt_f", F.col("raw_answer").isNull().alias("missing"),
                        extract_sql_answer(response).alias("answer"))
    answered = with_sql_features(answered, "answer", "p_f")
    score = F.when(F.col("missing"), F.lit(0.0)).otherwise(semantic_score(F.col("p_f"), F.col("gt_f")))
    match = ~F.col("missing") & (match_form(F.col("answer")) == F.col("gt_form"))
    scored = answered.select("ex_id", "label", "variant", "answer", "missing",
                             answer_status(F.col("variant"), F.coalesce("answer", F.lit("")), match).alias("correct"),
                             score.alias("raw_score"))
    return scored.select("ex_id", "label", "variant", "answer", "missing", "correct",
                         F.round("raw_score", 6).alias("score"), near_correct(F.col("raw_score")).alias("near_correct"))


def wide_results(long: DataFrame) -> DataFrame:
    """One row per sample with the four answers, flags and n_missing (pivot, O-JN-4)."""
    aggs = [F.count_if(F.col("missing")).cast("int").alias("n_missing")]
    for v in VARIANT_NAMES:
        aggs.append(F.max(F.when(F.col("variant") == v, F.col("answer"))).alias(f"{v}_answer"))
        aggs.append(F.max(F.when(F.col("variant") == v, F.col("correct"))).alias(f"{v}_correct"))
    return long.groupBy("ex_id", "label").agg(*aggs)


def _winner(counts: dict[str, Column]) -> Column:
    """First variant with the maximum (if > 0) in tie order, else Tie/None."""
    best = F.greatest(*counts.values())
    out = None
    for v in VARIANT_NAMES:
        cond = (counts[v] == best) & (counts[v] > 0)
        out = F.when(cond, F.lit(VARIANT_LABELS[v])) if out is None else out.when(cond, F.lit(VARIANT_LABELS[v]))
    return out.otherwise(F.lit(fixed.NO_WINNER))


def _pct(c: Column, total: Column) -> Column:
    return F.round(c.cast("double") * 100 / total, 6)


def accuracy_by_type(wide: DataFrame) -> DataFrame:
    """Per label: total, correct and pct per variant, winner (O-EV-1/2).

    Nulls (skipped / errored) stay in the denominator.
    """
    agg = wide.groupBy("label").agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("n_missing"), F.lit(0)).alias("n_missing"),
        *[F.count_if(F.coalesce(F.col(f"{v}_correct"), F.lit(False))).alias(f"{v}_n") for v in VARIANT_NAMES])
    counts = {v: F.col(f"{v}_n") for v in VARIANT_NAMES}
    return agg.select(
        "label", "total", "n_missing", *counts.values(),
        *[_pct(counts[v], F.col("total")).alias(f"{v}_pct") for v in VARIANT_NAMES],
        _winner(counts).alias("winner")).orderBy("label")


def overall_accuracy(wide: DataFrame) -> DataFrame:
    """One row: totals, accuracy fractions, pruning impact, best model (O-EV-3/4/5)."""
    t = lambda v: F.coalesce(F.col(f"{v}_correct"), F.lit(False))
    agg = wide.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("n_missing"), F.lit(0)).alias("n_missing"),
        *[F.count_if(t(v)).alias(f"{v}_n") for v in VARIANT_NAMES],
        F.count_if(t("finetuned_prune") & ~t("finetuned_no_prune")).alias("pruning_helps"),
        F.count_if(t("finetuned_no_prune") & ~t("finetuned_prune")).alias("pruning_hurts"))
    total = F.col("total")
    frac = lambda c: F.when(total > 0, F.round(c.cast("double") / total, 6)).otherwise(F.lit(0.0))
    counts = [F.col(f"{v}_n") for v in VARIANT_NAMES]
    best = F.greatest(*counts)
    best_model = None
    for v, c in zip(VARIANT_NAMES, counts):
        best_model = (F.when(c == best, F.lit(BEST_MODEL_LABELS[v])) if best_model is None
                      else best_model.when(c == best, F.lit(BEST_MODEL_LABELS[v])))
    return agg.select(
        "total", "n_missing", *counts,
        *[frac(F.col(f"{v}_n")).alias(f"{v}_acc") for v in VARIANT_NAMES],
        frac(F.col("finetuned_prune_n") - F.col("finetuned_no_prune_n")).alias("pruning_difference"),
        "pruning_helps", "pruning_hurts",
        F.when(F.col("finetuned_prune_n") > F.col("finetuned_no_prune_n"), "helps")
         .when(F.col("finetuned_prune_n") < F.col("finetuned_no_prune_n"), "hurts")
         .otherwise("no effect").alias("pruning_effect"),
        best_model.alias("best_model"),
        F.when(total > 0, F.round(best.cast("double") * 100 / total, 6)).otherwise(F.lit(0.0)).alias("best_pct"))


def category_wins(by_type: DataFrame) -> DataFrame:
    """Types won per variant, Tie/None included, plus the number of labels (O-EV-6).

    One global aggregate over the per-label rows (wide form, no join).
    """
    cols = [F.count_if(F.col("winner") == lab).alias(f"wins_{v}") for v, lab in fixed.VARIANTS]
    cols.append(F.count_if(F.col("winner") == fixed.NO_WINNER).alias("wins_tie_none"))
    return by_type.agg(*cols, F.count(F.lit(1)).alias("n_labels"))


def score_distribution(long: DataFrame) -> DataFrame:
    """Semantic-score summary per variant and label (O-EV-8).

    Rows are first counted per distinct score, so the exact median of a group
    that holds a large share of all rows is taken over its distinct scores.
    """
    per_score = long.groupBy("variant", "label", "score").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("near_correct").alias("_near"), F.count_if("correct").alias("_exact"))
    return per_score.groupBy("variant", "label").agg(
        F.sum("_n").alias("n"),
        F.round(F.sum(F.col("score") * F.col("_n")) / F.sum("_n"), 6).alias("avg_score"),
        F.round(F.percentile("score", F.lit(0.5), F.col("_n")), 6).alias("median_score"),
        F.sum("_near").alias("n_near_correct"), F.sum("_exact").alias("n_exact"))


def accuracy_rollup(long: DataFrame) -> DataFrame:
    """level, label, variant, total, n_missing, n_correct, pct, mean_score: per
    label and variant, per variant, and over all (O-EV-1/3/4 in one pass).

    The long table is aggregated once, per label and variant; the grouping sets
    run over those few rows.  A label or variant is null where a level sums
    over it; ``level`` tells that from a null label.
    """
    per = long.groupBy("label", "variant").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("missing").alias("n_missing"), F.count_if("correct").alias("n_correct"),
        F.sum(F.round(F.col("score") * 1_000_000).cast("long")).alias("_score"))
    sets = per.groupingSets([["label", "variant"], ["variant"], []], "label", "variant").agg(
        F.grouping_id().alias("_id"), *(F.sum(c).alias(c) for c in ("total", "n_missing", "n_correct", "_score")))
    level = F.when(F.col("_id") == 0, "label").when(F.col("_id") == 2, "variant").otherwise("all")
    return sets.filter(F.col("total").isNotNull()).select(
        level.alias("level"), "label", "variant", "total", "n_missing", "n_correct", _pct(F.col("n_correct"), F.col("total")).alias("pct"),
        F.round(F.col("_score") / 1_000_000 / F.col("total"), 6).alias("mean_score"))


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "ex_id") -> DataFrame:
    """Write ``df`` at ``path`` as table ``name``, bucketed and sorted by
    ``key``, and return it.  Tables with the same buckets join, and aggregate
    by ``key``, without a shuffle.

    Rows are dealt to their buckets first, so a bucket is one file; choose
    ``buckets`` for the table's size (one task reads one bucket).
    """
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("errorifexists")
     .saveAsTable(name))
    return df.sparkSession.table(name)
