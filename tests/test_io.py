import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import jsonl


def _write_lines(lines):
    d = tempfile.mkdtemp(prefix="tessera-io-")
    p = os.path.join(d, "part.jsonl")
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_read_jsonl_blank_comment_and_sql_keys(spark):
    d = _write_lines([json.dumps({"ex_id": 1, "question": "héllo", "SQL": "SELECT 1", "db_schema": "t(a INT)"}, ensure_ascii=False),
                      "", "   ", "# a comment",
                      json.dumps({"ex_id": 2, "question": "q2", "sql": "SELECT 2"})])
    rows = {r["ex_id"]: r for r in jsonl.read_jsonl(spark, d, skip_comments=True).collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["question"] == "héllo" and rows["2"]["SQL"] == "SELECT 2"
    assert rows["2"]["db_schema"] is None


def test_malformed_lines_stop_or_are_counted(spark):
    d = _write_lines(['{"ex_id": 1}', "# no JSON", "[1]", '{"ex_id": '])
    with pytest.raises(Exception, match="malformed JSON line"):
        jsonl.read_jsonl(spark, d).collect()
    assert [r["ex_id"] for r in jsonl.read_jsonl(spark, d, on_malformed="drop").collect()] == ["1"]
    assert [r["n_malformed"] for r in jsonl.malformed_lines(spark, d).collect()] == [3]
    assert [r["n_malformed"] for r in jsonl.malformed_lines(spark, d, skip_comments=True).collect()] == [2]


def test_record_keeps_unknown_fields(spark):
    lines = ['{"z":1.50,"db_schema":"s","q":{"a":[1,null]},"big":12345678901234567890,"none":null}', '{"only":"é"}']
    rows = jsonl.read_jsonl(spark, _write_lines(lines), keep_record=True)
    got = [json.loads(r[0]) for r in rows.select(jsonl.record_with("db_schema", F.lit("new"))).collect()]
    want = [json.loads(x) | {"db_schema": "new"} for x in lines]
    assert got == want and list(got[0]) == list(want[0])


def test_equal_rows_get_different_ids(spark):
    d = _write_lines(['{"question": "same"}'] * 5)
    ids = [r["ex_id"] for r in jsonl.with_position_id(jsonl.read_jsonl(spark, d)).collect()]
    assert len(set(ids)) == 5


def test_scratch_needs_a_shared_folder():
    from tessera import session

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_prefer_and_require_source(spark):
    d = _write_lines([json.dumps({"ex_id": 7, "SQL": "SELECT 7"})])
    missing = os.path.join(tempfile.mkdtemp(), "absent")
    got = jsonl.prefer_source(spark, [missing, d])
    assert [r["ex_id"] for r in got.collect()] == ["7"]
    none = jsonl.prefer_source(spark, [missing])
    assert none.count() == 0 and none.dtypes == got.dtypes
    with pytest.raises(FileNotFoundError):
        jsonl.require_source(spark, missing)


def test_write_jsonl_keeps_utf8_and_nulls(spark):
    out = os.path.join(tempfile.mkdtemp(), "out")
    df = spark.createDataFrame([(1, "ça", None)], "ex_id long, question string, db_id string")
    jsonl.write_jsonl(df, out)
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in os.listdir(out) if f.endswith(".json"))
    assert "ça" in text and '"db_id":null' in text


def test_write_report(spark):
    from tessera.operators import evaluate as ev
    from tessera.sources import fixtures as fx
    ex = fx.examples(spark, "/root/testdata/sf0.001")
    wide = ev.wide_results(ev.evaluate(ex, fx.predictions_from(ex)))
    out = os.path.join(tempfile.mkdtemp(), "report")
    metadata = jsonl.report_metadata(wide.count(), (2, 12), {"base": "b"})
    jsonl.write_report(out, metadata, ev.overall_accuracy(wide), ev.accuracy_by_type(wide), wide, ev.VARIANT_NAMES)
    summary = json.loads(spark.read.text(f"{out}/summary").first()[0])
    assert set(summary) == {"metadata", "overall_accuracy", "pruning_comparison", "n_missing"}
    assert set(summary["overall_accuracy"]) == set(ev.VARIANT_NAMES)
    assert summary["metadata"]["schema_pruning"] == {"tested_both": True, "min_tables": 2, "max_columns": 12}
    assert summary["metadata"]["total_examples"] == wide.count() and "evaluated_at" in summary["metadata"]
    assert spark.read.json(f"{out}/results").count() == wide.count()


def test_ordered_files_follow_the_session(spark, monkeypatch, tmp_path):
    from tessera.plans import queries
    path = str(tmp_path / "ordered")
    monkeypatch.setattr(queries, "scratch_path", lambda *_: path)
    settings = {"spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = queries.QUERIES["io_tail_by_file_order"](spark, "/root/testdata/sf0.001").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "ordered").glob("part-*"))) == 6
    dev = [r["ex_id"] for r in got if r["split"] == "dev"]
    assert dev and min(dev) > max(r["ex_id"] for r in got if r["split"] != "dev")
