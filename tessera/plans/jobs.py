"""End-to-end jobs over files: the entry points a corpus user runs.

    python -m tessera.plans.jobs balance   --input train.jsonl --output balanced/
    python -m tessera.plans.jobs prune     --input data.jsonl  --output pruned/ [--min-tables 1 --max-columns 10 --mode documented]
    python -m tessera.plans.jobs reformat  --input data.jsonl  --output clear/
    python -m tessera.plans.jobs prepare   --input balanced/   --output inputs/ [--dev-size 200 --prune]
    python -m tessera.plans.jobs evaluate  --test test.jsonl --predictions preds/ --output report/

Every job reads and writes through Spark (JSON lines or parquet folders), so
input and output can live on any Hadoop-compatible storage.  Records keep all
their fields; a job replaces only the one it computes.  Results are written
first, and reports are taken from what was written.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed
from tessera.operators import curate, evaluate as ev, schema_ops
from tessera.operators.model_inputs import training_examples
from tessera.session import scratch_path
from tessera.sources import jsonl


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def balance(spark: SparkSession, input_path: str, output_path: str, seed: int = curate.SEED) -> DataFrame:
    """Classify, sample per class, fill shortfalls from templates, shuffle,
    write; returns the target check.  Sampled records keep all their fields."""
    rows = jsonl.read_jsonl(spark, input_path, keep_record=True)
    examples = jsonl.with_position_id(rows).withColumn("record", F.to_json("record", {"ignoreNullFields": "false"}))
    balanced = _written(curate.balanced_dataset(examples, spark, seed, keep=["record"]), "balanced")
    made = F.to_json(F.struct("question", "SQL", "db_schema", "db_id"), {"ignoreNullFields": "false"})
    record = F.from_json(F.coalesce("record", made), jsonl.RECORD)
    line = jsonl.record_with("query_type", F.col("query_type"))
    curate.shuffled(balanced.withColumn("record", record)).select(line.alias("value")).write.mode("overwrite").text(output_path)
    return curate.target_check(balanced, spark)


def prune(spark: SparkSession, input_path: str, output_path: str, min_tables: int = fixed.PRUNE_TRAIN[0],
          max_columns: int = fixed.PRUNE_TRAIN[1], mode: str = schema_ops.MODE) -> DataFrame:
    """Replace every record's schema by its pruned form; returns changed / total / percent."""
    rows = jsonl.read_jsonl(spark, input_path, keep_record=True)
    pruned = schema_ops.prune_schemas(rows, min_tables, max_columns, mode=mode)
    done = _written(pruned.select("db_schema", "pruned_schema", jsonl.record_with("db_schema", F.col("pruned_schema"))
                                  .alias("value")), "pruned")
    done.select("value").write.mode("overwrite").text(output_path)
    return schema_ops.prune_dataset_report(done)


def reformat(spark: SparkSession, input_path: str, output_path: str, mode: str = schema_ops.MODE) -> None:
    """Replace every record's schema by its clear rendering."""
    rows = jsonl.read_jsonl(spark, input_path, keep_record=True)
    out = schema_ops.reformat_schemas(rows, mode=mode)
    out.select(jsonl.record_with("db_schema", F.col("formatted_schema")).alias("value")) \
        .write.mode("overwrite").text(output_path)


def prepare(spark: SparkSession, input_path: str, output_path: str, dev_size: int = fixed.DEV_SUBSET_SIZE,
            use_pruning: bool = False, mode: str = schema_ops.MODE) -> DataFrame:
    """Tail split (file order) and training prompt rendering; writes train/ and dev/ parquet."""
    rows = jsonl.with_position_id(jsonl.read_jsonl(spark, input_path))
    formatted = training_examples(rows, fixed.PRUNE_TRAIN if use_pruning else None, mode)
    done = _written(formatted.select("ord", "ex_id", "input", "output", "full_text"), "prompts")
    split = curate.tail_split(done, ["ord"], "ord", dev_size)
    base = output_path.rstrip("/")
    for part in ("train", "dev"):
        split.filter(F.col("split") == part).drop("split", "ord").write.mode("overwrite").parquet(f"{base}/{part}")
    return curate.dataset_report(split)


def evaluate(spark: SparkSession, test_path: str, predictions_path: str, output_path: str,
             max_samples: int | None = None, models: dict[str, str] | None = None,
             mode: str = schema_ops.MODE) -> DataFrame:
    """Valid-schema test rows x predictions (ex_id, variant, raw_answer) -> report tables.

    Test records need a unique ``ex_id`` field.  All of them are evaluated
    unless the caller asks for the first ``max_samples``.
    """
    test = jsonl.require_source(spark, test_path, skip_comments=True)
    test = test.filter(ev.valid_schema(F.col("db_schema")))
    if max_samples is not None:
        test = ev.head_n(test, "ord", max_samples)
    preds = spark.read.parquet(predictions_path).select(F.col("ex_id").cast("string"), "variant", "raw_answer")
    wide = _written(ev.wide_results(ev.evaluate(test, preds, mode=mode)), "results")
    overall = ev.overall_accuracy(wide)
    total = overall.first()["total"]
    metadata = jsonl.report_metadata(total, fixed.PRUNE_EVAL, models or {})
    jsonl.write_report(output_path, metadata, overall, ev.accuracy_by_type(wide), wide, ev.VARIANT_NAMES)
    return overall


def main(argv: list[str] | None = None) -> None:
    from tessera.session import build_session
    p = argparse.ArgumentParser(prog="tessera.plans.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    for name in ("balance", "prune", "reformat", "prepare"):
        s = sub.add_parser(name)
        s.add_argument("--input", required=True)
        s.add_argument("--output", required=True)
        if name != "balance":
            s.add_argument("--mode", default=schema_ops.MODE, choices=schema_ops.MODES)
        if name == "prune":
            s.add_argument("--min-tables", type=int, default=fixed.PRUNE_TRAIN[0])
            s.add_argument("--max-columns", type=int, default=fixed.PRUNE_TRAIN[1])
        if name == "prepare":
            s.add_argument("--dev-size", type=int, default=fixed.DEV_SUBSET_SIZE)
            s.add_argument("--prune", action="store_true")
    s = sub.add_parser("evaluate")
    s.add_argument("--test", required=True)
    s.add_argument("--predictions", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--mode", default=schema_ops.MODE, choices=schema_ops.MODES)
    for sp in sub.choices.values():
        sp.add_argument("--master", default=None, help="omit on a cluster (spark-submit sets it)")
        sp.add_argument("--report", default=None, help="where to write the job's report rows as JSON lines")
    a = p.parse_args(argv)
    spark = build_session(master=a.master, shuffle_partitions=None)
    if a.job == "balance":
        out = balance(spark, a.input, a.output)
    elif a.job == "prune":
        out = prune(spark, a.input, a.output, a.min_tables, a.max_columns, a.mode)
    elif a.job == "reformat":
        reformat(spark, a.input, a.output, a.mode)
        return
    elif a.job == "prepare":
        out = prepare(spark, a.input, a.output, a.dev_size, a.prune, a.mode)
    else:
        out = evaluate(spark, a.test, a.predictions, a.output, mode=a.mode)
    report = a.report or f"{a.output.rstrip('/')}-report"
    jsonl.write_jsonl(out, report)
    print(f"report: {report}")


if __name__ == "__main__":
    main()
