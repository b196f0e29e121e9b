import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera import fixed
from tessera.plans import jobs
from tessera.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _corpus(spark):
    d = tempfile.mkdtemp(prefix="tessera-jobs-")
    ex = fx.examples(spark, SF)
    ex.select(F.to_json(F.struct("ex_id", "db_id", "question", "SQL", "db_schema", "query_type_name",
                                 F.lit("hard").alias("difficulty"), F.lit(1.5).alias("weight"))).alias("v")) \
        .write.text(f"{d}/corpus")
    fx.predictions_from(ex).write.parquet(f"{d}/preds")
    return d, ex


def test_jobs_end_to_end(spark):
    d, ex = _corpus(spark)
    check = {r["query_type"]: r for r in jobs.balance(spark, f"{d}/corpus", f"{d}/balanced").collect()}
    for q in fixed.SYNTHETIC_TEMPLATES:            # generator classes reach their target exactly
        assert check[q]["actual"] == check[q]["target"]
    rep = jobs.prune(spark, f"{d}/corpus", f"{d}/pruned").collect()[0]
    assert rep["n_total"] == ex.count() and 0 < rep["n_pruned"] <= rep["n_total"]
    for name in ("pruned", "balanced"):              # fields that no job knows come through
        rows = spark.read.json(f"{d}/{name}").filter("ex_id is not null")
        assert rows.count() > 0 and rows.filter("difficulty = 'hard' and weight = 1.5").count() == rows.count()
    pruned = spark.read.json(f"{d}/pruned")
    assert pruned.count() == ex.count() and pruned.join(ex.select("ex_id", F.coalesce("query_type_name", F.lit("-")).alias("t")), "ex_id") \
        .filter("coalesce(query_type_name, '-') <> t").count() == 0
    jobs.reformat(spark, f"{d}/corpus", f"{d}/clear")
    assert spark.read.json(f"{d}/clear").filter(F.col("db_schema").startswith("Table: ")).count() > 0
    split = jobs.prepare(spark, f"{d}/balanced", f"{d}/inputs").collect()[0]
    assert split["n_dev"] == fixed.DEV_SUBSET_SIZE and split["n_train"] == split["total"] - fixed.DEV_SUBSET_SIZE
    assert spark.read.parquet(f"{d}/inputs/dev").count() == fixed.DEV_SUBSET_SIZE
    overall = jobs.evaluate(spark, f"{d}/corpus", f"{d}/preds", f"{d}/report", max_samples=100).collect()[0]
    assert overall["total"] == 100
    summary = json.loads(open([os.path.join(f"{d}/report/summary", f) for f in os.listdir(f"{d}/report/summary")
                               if f.startswith("part-")][0]).read())
    assert 0.0 <= summary["overall_accuracy"]["base"] <= 1.0 and summary["metadata"]["total_examples"] == 100
