import pytest

from tessera.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SIDE_EFFECT = {"io_jsonl_roundtrip", "st_classify_stream", "st_class_counts_stream", "io_write_jsonl", "io_prefer_source",
               "io_require_source", "io_tail_by_file_order", "st_prune_stream"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SIDE_EFFECT))
def test_no_python_in_plan(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_sample_uses_partial_group_limit(spark):
    p = QUERIES["cu_stratified_sample"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_anti_joins_and_pushdown(spark):
    p = plan(QUERIES["wl_anti_join_not_exists"](spark, SF))
    assert "LeftAnti" in p and any("EqualTo(o_orderpriority,1-URGENT)" in x.split("]")[0] for x in p.split("PushedFilters")[1:])
    p = plan(QUERIES["wl_anti_join_not_in"](spark, SF))
    assert "LeftAnti" in p


def test_no_forced_hash_join_and_no_round_robin(spark):
    for name in ("ev_evaluate", "sc_semantic_score", "sch_prune_eval", "pr_chat_render", "cu_overlap_check"):
        p = plan(QUERIES[name](spark, SF))
        assert "ShuffledHashJoin" not in p and "RoundRobin" not in p, name
    p = plan(QUERIES["ev_evaluate"](spark, SF))
    assert "SortMergeJoin [ex_id" in p and "BroadcastHashJoin [ex_id" not in p


def test_scoring_keeps_its_partitions(spark):
    scored = QUERIES["sc_semantic_score"](spark, SF)    # a few hundred KB: AQE would merge them into one task
    assert scored.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_not_in_is_a_shuffled_anti_join_of_distinct_keys(spark):
    p = plan(QUERIES["wl_anti_join_not_in"](spark, SF))
    assert "SortMergeJoin" in p and "LeftAnti" in p and "Broadcast" not in p and "HashAggregate" in p


def test_not_in_null_rules(spark):
    from tessera.plans.workload import rows_not_in
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    listed = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    assert rows_not_in(rows, "k", listed).count() == 0
    assert [r["k"] for r in rows_not_in(rows, "k", listed.filter("x is not null")).collect()] == [2]
    assert rows_not_in(rows, "k", listed.limit(0)).count() == 3


def test_not_in_runs_no_job_before_its_result(spark, tmp_path):
    from tessera.plans.workload import rows_not_in
    spark.range(3).selectExpr("int(id) AS x").write.parquet(str(tmp_path / "listed"))
    listed = spark.read.schema("x int").parquet(str(tmp_path / "listed"))
    spark.sparkContext.setJobGroup("not-in", "building the plan")
    try:
        got = rows_not_in(spark.range(5).selectExpr("int(id) AS k"), "k", listed)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("not-in")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["k"] for r in got.collect()) == [3, 4]


def test_sample_ranks_narrow_rows_and_deficit_needs_no_scan(spark):
    p = plan(QUERIES["cu_balanced_dataset"](spark, SF))
    scans = [x for x in p.split("\n") if "FileScan parquet" in x]
    # Rows are ranked by key alone; the only scan with all columns fetches the
    # winners.  The deficit reuses the ranking.
    payload = [x for x in scans if "o_orderpriority" in x and "o_orderdate" in x]
    ranked = p[p.index("WindowGroupLimit"):]
    assert "db_schema" not in "".join(x for x in p.split("\n") if "WindowGroupLimit" in x or "Sort [query_type" in x)
    assert payload and ranked


def test_catalog_join_is_not_broadcast_on_an_estimate(spark):
    p = plan(QUERIES["sch_prune_eval"](spark, SF))
    assert "SortMergeJoin [_schema_key" in p


def test_nothing_of_the_engine_needs_the_subpackage(spark):
    import pathlib
    root = pathlib.Path(__file__).parent.parent / "tessera"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tessera.llm" not in f.read_text(), f
