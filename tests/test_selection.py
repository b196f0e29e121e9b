"""Selection by rank: exact keys, quotas, dense numbers, without whole sorts."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import curate, evaluate as ev, ranked_context as rc, selection
from tessera.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("values", [list(range(3000)), [7] * 1500 + list(range(1500)), [f"{x % 50:03d}" for x in range(2500)], [1, 1, 1]])
def test_nth_largest(spark, values):
    """Few splitters and a short last step, so that rounds follow each other;
    one value may hold half of all rows."""
    random.Random(3).shuffle(values)
    kind = "string" if isinstance(values[0], str) else "long"
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, f"k {kind}").repartition(3)
    ranked = sorted(values, reverse=True)
    for n in {1, 2, len(values) // 3, len(values) - 1, len(values)}:
        got = selection.nth_largest(df, "k", n, splitters=3, few=20)
        assert got == (ranked[n - 1], sum(v > ranked[n - 1] for v in values))


def test_in_last_with_ties_and_nulls(spark):
    rows = [(None if i % 9 == 0 else i % 4, i) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(2)
    ranked = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n in (0, 1, 90, 361, 399, 400, 500):
        got = {r["b"] for r in df.filter(selection.in_last(df, ["a", "b"], n, splitters=3, few=10)).collect()}
        assert got == {b for _, b in ranked[max(0, 400 - n):]}
    with pytest.raises(ValueError):
        selection.in_last(df, ["a"], 50, splitters=3, few=10)
    empty = selection.tail_share(df.limit(0), ["a", "b"], 0.1)
    assert empty.columns == ["a", "b", "split"] and empty.count() == 0


def test_tail_share_plan(spark, capsys):
    QUERIES["cu_tail_share"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("TakeOrdered", "Exchange", "Sort", "Join"))


@pytest.mark.parametrize("prefix", [1, 4])
def test_quota_sample(spark, prefix):
    rows = [(i, "hot" if i % 3 else f"c{i % 5}" if i % 2 else None) for i in range(1200)]
    df = spark.createDataFrame(rows, "ex_id long, query_type string").repartition(3)
    got = selection.quota_sample(df, F.when(F.col("query_type") == "c1", 0).otherwise(F.ceil(F.col("n") / 7)),
                                 curate.sample_key(F.col("ex_id")), prefix=prefix)
    keys = {r["ex_id"]: r["k"] for r in df.select("ex_id", curate.sample_key(F.col("ex_id")).alias("k")).collect()}
    want = set()
    for c in {c for _, c in rows} - {"c1"}:
        own = sorted((keys[i], i) for i, k in rows if k == c)
        want |= {(i, c) for _, i in own[:-(-len(own) // 7)]}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert selection.quota_sample(df.limit(0), F.col("n"), curate.sample_key(F.col("ex_id"))).count() == 0


def test_row_number_over_files_and_splits(spark, tmp_path):
    """Dense over many files and splits, after rows were filtered out."""
    path = str(tmp_path / "lines")
    spark.range(5000).repartitionByRange(4, "id").sortWithinPartitions("id").select(F.col("id").cast("string").alias("value")).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"))
        assert rows.select("f", "s").distinct().count() > 8
        kept = rows.filter(F.col("value").cast("long") % 3 != 0)
        got = [(int(r["value"]), r["row_number"]) for r in selection.with_row_number(kept, F.col("f"), F.col("s")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [x for x in range(5000) if x % 3]
    assert sorted(got) == [(x, i) for i, x in enumerate(want, 1)]
    assert selection.with_row_number(kept.limit(0), F.col("f"), F.col("s")).count() == 0


# --- ranked context -------------------------------------------------------

CARDS = [("s", 0, 0, "Table customers: \nColumns: id, name"), ("s", 1, 0, "Table orders: \nColumns: id, customer_id, total"),
         ("s", 2, 0, "Table parts: \nColumns: id, weight"), ("s", 3, 0, "Table parts: \nColumns: id, weight")]


def test_ranked_context(spark):
    schema = F.lit("schema text")
    cards = spark.createDataFrame(CARDS, "s string, table_pos int, card_page int, card string").select(F.md5(schema).alias("schema_id"), "table_pos", "card_page", "card")
    asked = [(1, "weight of parts", "schema text"), (2, "nothing that matches", "schema text"), (3, None, "schema text"), (4, "weight", "no card"),
             (5, "total of orders by weight", "schema text"), (5, "total of orders by weight", "schema text"), (6, "total", None)]
    df = spark.createDataFrame(asked, "ex_id long, question string, db_schema string")
    got = {r["ex_id"]: r for r in rc.ranked_context(df, cards, k=3, budget=13).collect()}
    assert rc.ranked_context(df, cards, k=3, budget=13).count() == 7
    assert got[1]["cards"] == "2.0 3.0" and got[1]["context"] == "\n\n".join([CARDS[2][3]] * 2)     # ties in schema order; the third exceeds 13
    assert got[2]["cards"] == got[3]["cards"] == "0.0 1.0" and got[2]["best_score"] == 0
    assert got[4]["cards"] == got[6]["cards"] == "" and got[4]["n_cards"] == 0 and got[4]["context"] == ""
    assert got[5]["cards"].startswith("1.0 ")
    assert rc.ranked_context(df, cards, budget=1).filter("ex_id = 1").first()["n_cards"] == 1
    assert rc.ranked_context(df.limit(0), cards).count() == 0


def test_weightless_tokens_have_no_postings(spark):
    cards = spark.createDataFrame([("s", i, i, 0, f"Table t{i}: \nColumns: shared, own{i}") for i in range(2000)],
                                  "schema_id string, place int, table_pos int, card_page int, card string")
    tokens = {r["token"] for r in rc.postings(cards).select("token").distinct().collect()}
    assert "own7" in tokens and "shared" not in tokens and "columns" not in tokens


# --- evaluation from stored tables ----------------------------------------

def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    rows = [(i, "l", "SELECT 1", 0, 0) for i in range(60)]
    samples = spark.createDataFrame(rows, "ex_id long, label string, gt_sql string, prompt_len int, pruned_prompt_len int")
    answers = spark.createDataFrame([(i, v, "SELECT 1") for i in range(60) for v in ev.VARIANT_NAMES], "ex_id long, variant string, raw_answer string")
    a, b = (ev.write_bucketed(df, f"stored_{n}", str(tmp_path / n), 8) for df, n in ((samples, "a"), (answers, "b")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = ev.evaluate(None, b, samples=a)
        plan = long._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert long.filter("correct").count() == 240
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in "ab":
            spark.sql(f"DROP TABLE stored_{n}")


def test_rollup_agrees_with_the_reports(spark):
    up = {(r["level"], r["label"], r["variant"]): r for r in QUERIES["ev_rollup"](spark, SF).collect()}
    overall = QUERIES["ev_overall_accuracy"](spark, SF).first()
    for v in ev.VARIANT_NAMES:
        assert up["variant", None, v]["n_correct"] == overall[f"{v}_n"]
    assert up["all", None, None]["total"] == 4 * overall["total"]
    for r in QUERIES["ev_accuracy_by_type"](spark, SF).collect():
        assert [up["label", r["label"], v]["n_correct"] for v in ev.VARIANT_NAMES] == [r[f"{v}_n"] for v in ev.VARIANT_NAMES]


# --- near overlap ---------------------------------------------------------

def test_near_overlap_by_brute_force(spark):
    """Random sets over few and many words, with copies; one word in all."""
    from tessera.operators import near_overlap as no
    rnd = random.Random(2)
    def text(i):
        n = rnd.randint(0, 14)
        own = rnd.sample(range(16), min(n, 16)) if i % 2 else [rnd.randint(0, 400) for _ in range(n)]
        return " ".join(["every"] * (i % 7 > 0) + [f"w{x}" for x in own])
    train = [text(i) for i in range(150)]
    test = [text(i) for i in range(100)] + train[:40] + [t.replace("w1 ", "w2 ") for t in train[:40]] + ["", None]
    a = spark.createDataFrame(list(enumerate(test)), "ex_id long, t string").repartition(3)
    b = spark.createDataFrame([(t,) for t in train + train[:30]], "t string")
    sets = {frozenset(t.split()) for t in train} - {frozenset()}
    want = {}
    for i, t in enumerate(test):
        own = set((t or "").split())
        near = [len(own & s) / len(own | s) for s in sets if own and 5 * len(own & s) >= 4 * len(own | s)]
        want[i] = (len(near), round(max(near, default=0.0), 6))
    got = {r["ex_id"]: (r["n_near"], r["similarity"]) for r in no.near_overlap(a, b, "t").collect()}
    assert got == want and sum(n > 0 for n, _ in want.values()) > 60
    assert no.near_overlap(a.limit(0), b, "t").count() == 0
    assert {r["n_near"] for r in no.near_overlap(a, b.limit(0), "t").collect()} == {0}


# --- rejected lines -------------------------------------------------------

def test_rejects(spark, tmp_path):
    from tessera.sources import jsonl
    lines = ['{"ex_id": 1, "SQL": "a"}', "", "   ", "# note", '{"ex_id": 2, "sql": "b"', "[1]", '{"ex_id": 3, "sql": "c"}', "plain"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text("\n".join(lines), encoding="utf-8")
    records, rejects, counts = jsonl.read_with_rejects(spark, str(tmp_path / "in"), fields=["ex_id", "SQL"])
    assert sorted((r["ex_id"], r["SQL"]) for r in records.collect()) == [("1", "a"), ("3", "c")]
    assert sorted((r["kind"], r["value"]) for r in rejects.collect()) == [
        ("blank", ""), ("blank", "   "), ("comment", "# note"), ("malformed", "[1]"), ("malformed", "plain"), ("malformed", '{"ex_id": 2, "sql": "b"')]
    assert counts == {"record": 2, "malformed": 3, "comment": 1, "blank": 2}
    assert jsonl.read_with_rejects(spark, str(tmp_path / "in"), skip_comments=False, fields=["ex_id"])[2]["malformed"] == 4
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.jsonl").write_text("", encoding="utf-8")
    records, rejects, counts = jsonl.read_with_rejects(spark, str(tmp_path / "none"))
    assert records.count() == rejects.count() == 0 and set(counts.values()) == {0}
