import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as ev

VARS = ["base", "finetuned_no_prune", "finetuned_prune", "llama"]


def _wide(spark, rows):
    """rows: (ex_id, label, base, ft_np, ft_p, llama) correctness (True/False/None)."""
    schema = "ex_id long, label string, " + ", ".join(f"{v}_correct boolean" for v in VARS)
    df = spark.createDataFrame(rows, schema).withColumn("n_missing", F.lit(0))
    for v in VARS:
        df = df.withColumn(f"{v}_answer", F.lit("x"))
    return df


def test_winner_ties_follow_variant_order(spark):
    rows = [
        (1, "a", True, True, True, True),      # all tie -> Base
        (2, "b", False, True, True, False),    # tie FT(NoPrune)/FT(Prune) -> FT(NoPrune)
        (3, "c", False, False, True, True),    # tie FT(Prune)/Llama3 -> FT(Prune)
        (4, "d", False, False, False, True),   # Llama3 alone
        (5, "e", False, False, False, False),  # all zero -> Tie/None
        (6, "f", None, None, None, None),      # all null -> Tie/None, nulls stay in the denominator
    ]
    got = {r["label"]: r for r in ev.accuracy_by_type(_wide(spark, rows)).collect()}
    assert [got[k]["winner"] for k in "abcdef"] == ["Base", "FT(NoPrune)", "FT(Prune)", "Llama3", "Tie/None", "Tie/None"]
    assert got["f"]["total"] == 1 and got["f"]["base_pct"] == 0.0
    wins = ev.category_wins(ev.accuracy_by_type(_wide(spark, rows))).collect()[0]
    assert (wins["wins_base"], wins["wins_finetuned_no_prune"], wins["wins_finetuned_prune"], wins["wins_llama"],
            wins["wins_tie_none"], wins["n_labels"]) == (1, 1, 1, 1, 2, 6)


def test_overall_pruning_impact_and_best_model(spark):
    rows = [(1, "a", False, True, None, None), (2, "a", False, None, True, None), (3, "a", False, True, True, None),
            (4, "a", False, False, False, None)]
    o = ev.overall_accuracy(_wide(spark, rows)).collect()[0]
    assert o["total"] == 4 and o["finetuned_no_prune_n"] == 2 and o["finetuned_prune_n"] == 2
    assert o["pruning_helps"] == 1 and o["pruning_hurts"] == 1 and o["pruning_difference"] == 0.0
    assert o["pruning_effect"] == "no effect" and o["best_model"] == "Fine-tuned (No Prune)"
    zero = ev.overall_accuracy(_wide(spark, [(1, "a", False, False, False, False)])).collect()[0]
    assert zero["best_model"] == "Base" and zero["best_pct"] == 0.0


def test_answer_status_tri_state(spark):
    rows = [("base", "ERROR: x"), ("finetuned_no_prune", "SKIPPED: y"), ("finetuned_prune", "ERROR: z"),
            ("llama", "ERROR: w"), ("llama", "SKIPPED: v")]
    df = spark.createDataFrame(rows, "variant string, answer string")
    got = [r[0] for r in df.select(ev.answer_status(F.col("variant"), F.col("answer"), F.lit(False))).collect()]
    # base errors count as wrong; SKIPPED is null only for the fine-tuned variants, ERROR only for llama
    assert got == [False, None, False, None, False]


EXAMPLE = "ex_id long, db_id string, question string, `SQL` string, db_schema string, query_type_name string"
PREDICTION = "ex_id long, variant string, raw_answer string"
SCHEMA = "customer(c_id INT, c_name TEXT; PK(c_id)); nation(n_id INT, n_name TEXT)"


def test_missing_predictions_count_as_wrong(spark):
    ex = spark.createDataFrame([(i, "d", "customer names", "SELECT 1", SCHEMA, None) for i in (1, 2, 3)], EXAMPLE)
    preds = spark.createDataFrame([(1, v, "SELECT 1") for v in VARS] + [(9, "base", "SELECT 1"), (2, "base", None)], PREDICTION)
    long = ev.evaluate(ex, preds)
    assert long.count() == 12 and long.filter("missing").count() == 8
    o = ev.overall_accuracy(ev.wide_results(long)).collect()[0]
    assert (o["total"], o["base_n"], o["base_acc"], o["n_missing"]) == (3, 1, 0.333333, 8)
    none = ev.overall_accuracy(ev.wide_results(ev.evaluate(ex, preds.limit(0)))).collect()[0]
    assert (none["total"], none["llama_acc"], none["n_missing"]) == (3, 0.0, 12)


def test_duplicate_or_null_ids_are_errors(spark):
    row = ("d", "customer names", "SELECT 1", SCHEMA, None)
    one = [(1, v, "SELECT 1") for v in VARS]
    for ids, preds in (((1, 1), one), ((1, None), one), ((1,), one + one[:1])):
        ex = spark.createDataFrame([(i, *row) for i in ids], EXAMPLE)
        with pytest.raises(Exception, match="ex_id"):
            ev.evaluate(ex, spark.createDataFrame(preds, PREDICTION)).collect()


def test_null_question_echo_is_stripped(spark):
    from tessera import fixed
    ex = spark.createDataFrame([(1, "d", None, "SELECT 1", SCHEMA, None)], EXAMPLE)
    prompt = fixed.EVAL_PROMPT.replace("{schema}", SCHEMA).replace("{question}", "")
    preds = spark.createDataFrame([(1, "base", prompt + "SELECT 1")], PREDICTION)
    assert ev.evaluate(ex, preds).filter("variant = 'base'").collect()[0]["correct"] is True


def test_near_correct_is_taken_before_rounding(spark):
    from tessera.functions.sqltext import near_correct
    got = spark.createDataFrame([(0.8999999999999999,), (0.9,), (0.89999951,)], "s double") \
        .select(near_correct(F.col("s"))).collect()
    assert [r[0] for r in got] == [False, True, False]


def test_score_distribution_median_from_counts(spark):
    rows = [("base", "a", s, s >= 0.9, None) for s in (0.1, 0.5, 0.5, 0.5, 0.95, 0.95)] + [("llama", "a", 0.3, False, True)]
    df = spark.createDataFrame(rows, "variant string, label string, score double, near_correct boolean, correct boolean")
    got = {r["variant"]: r for r in ev.score_distribution(df).collect()}
    assert (got["base"]["n"], got["base"]["median_score"], got["base"]["n_near_correct"], got["base"]["n_exact"]) == (6, 0.5, 2, 0)
    assert got["base"]["avg_score"] == round(3.5 / 6, 6) and got["llama"]["n_exact"] == 1
