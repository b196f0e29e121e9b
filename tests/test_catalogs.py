"""Table selection by joins, pruning on a stream, mergeable score sketches."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.functions.schema_text import name_matches, parse_schema_documented, prune_parsed, question_tokens
from tessera.operators import fk_closure, schema_ops, score_sketch
from tessera.streaming import schema_stream

WORDS = "order orders customer cust part parts ship item line region nation invoice a ab pay payment cat category".split()


def random_schema(rng: random.Random, n: int, keys: int = 1) -> str:
    names = [f"{rng.choice(WORDS)}_{rng.choice(WORDS)}{i}" if rng.random() < 0.8 else f"{rng.choice(WORDS)}{i}" for i in range(n)]
    tables = []
    for name in names:
        refs = [rng.choice([*names, name, "elsewhere"]) for _ in range(rng.randint(0, keys))]
        fks = "".join(f", FK(c{k} REFERENCES {r}(id))" for k, r in enumerate(refs))
        tables.append(f"{name}(id INT, c0 INT, c1 INT; PK(id){fks})")
    return "; ".join(tables)


def plain_selection(tables: list, tokens: set, min_tables: int, matches) -> dict:
    """{table: step} by the rule of the in-row selection, table by table."""
    keys = [t["key"] for t in tables]
    refs = {t["key"]: [f["ref_table"] for f in t["fks"]] for t in tables}
    step = {k: "matched" for k in keys if matches(k, tokens)}
    for k in list(step):
        for r in refs[k]:
            if r in refs:
                step.setdefault(r, "referenced")
    for k in keys:
        if k not in step and any(r in step for r in refs[k]):
            step[k] = "referencing"
    degree = {k: len(refs[k]) + sum(r == k for rs in refs.values() for r in rs) for k in keys}
    spare = sorted((k for k in keys if k not in step), key=lambda k: (degree[k], k), reverse=True)
    return step | dict.fromkeys(spare[:max(min_tables - len(step), 0)], "added")


def plain_matches(name: str, tokens: set) -> bool:
    return (name in tokens or any(len(p) > 1 and p in tokens for p in name.split("_"))
            or any(len(t) > 2 and (t in name or name in t) for t in tokens))


def selected_of(spark, df, min_tables):
    catalog = schema_ops.parsed_catalog(df, mode="documented").cache()
    pairs = fk_closure.question_pairs(df)
    got = fk_closure.select_tables(pairs, fk_closure.table_rows(catalog), fk_closure.edge_rows(catalog), min_tables)
    return catalog, pairs, got


@pytest.mark.parametrize("min_tables", [0, 2, 7])
def test_selection_by_joins(spark, min_tables):
    rng = random.Random(min_tables)
    schemas = [random_schema(rng, rng.randint(1, 25), rng.choice([1, 1, 2])) for _ in range(12)] + ["", None, "no schema"]
    questions = [" ".join(rng.choices([*WORDS, "the", "xyz"], k=rng.randint(0, 4))) for _ in range(5)] + [None, ""]
    rows = [(s, q) for s in schemas for q in questions] * 2
    df = spark.createDataFrame(rows, "db_schema string, question string")
    catalog, pairs, got = selected_of(spark, df, min_tables)
    tables = {r["schema_id"]: r["tables"] for r in catalog.collect()}
    asked = pairs.withColumn("tokens", question_tokens(F.col("question"))).collect()
    want = {(r["pair"], k, s) for r in asked
            for k, s in plain_selection(tables[r["schema_id"]], set(r["tokens"]), min_tables, plain_matches).items()}
    rows = [(r["pair"], r["table_key"], r["step"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert {s for _, _, s in rows} >= {"matched", "referenced", "referencing"}


def test_names_meet_tokens(spark):
    rng = random.Random(5)
    letters = "abcé_"
    names = sorted({"".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(150)})
    tokens = sorted({"".join(rng.choices("abcé", k=rng.randint(2, 8))) for _ in range(150)})
    tables = spark.createDataFrame([("s", n) for n in names], "schema_id string, table_key string")
    asked = spark.createDataFrame([("s", t) for t in tokens * 2] + [("other", "abc")], "schema_id string, token string")
    got = sorted((r["token"], r["table_key"]) for r in fk_closure.matching_tables(asked, tables).collect())
    every = spark.createDataFrame([(t, n) for t in tokens for n in names], "t string, n string")
    want = sorted(map(tuple, every.filter(name_matches(F.col("n"), F.array("t"))).collect()))
    assert got == want and 100 < len(want) < len(tokens) * len(names)


def test_selection_over_a_large_schema(spark):
    """5,000 tables: the joins select what the in-row rule selects."""
    rng = random.Random(1)
    df = spark.createDataFrame([(random_schema(rng, 5_000), "which region has invoice xyz")], "db_schema string, question string")
    catalog, _, got = selected_of(spark, df, 2)
    row = catalog.crossJoin(df.select("question")).select(
        prune_parsed(F.col("tables"), question_tokens(F.col("question")), F.lit(""), 2, 10, documented=True).alias("p"))
    want = {k for r in row.select(F.transform(parse_schema_documented(F.col("p")), lambda t: t["key"])).collect() for k in r[0]}
    rows = [r["table_key"] for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and 500 < len(want) < 5_000


def test_selection_of_nothing(spark):
    df = spark.createDataFrame([], "db_schema string, question string")
    assert selected_of(spark, df, 2)[2].count() == 0
    df = spark.createDataFrame([("orders(id INT; PK(id))", None)], "db_schema string, question string")
    assert [(r["table_key"], r["step"]) for r in selected_of(spark, df, 2)[2].collect()] == [("orders", "added")]


# --- pruning on a stream --------------------------------------------------

SCHEMA = "ex_id long, question string, db_schema string"


def stream_rows():
    rng = random.Random(3)
    texts = [random_schema(rng, 6) for _ in range(4)] + [None, "", "no schema"]
    return [[(100 * b + i, rng.choice([None, "orders of a customer", "nation"]), texts[(i * (b + 1)) % len(texts)]) for i in range(20)]
            for b in range(3)], texts


def test_prune_on_a_stream(spark, tmp_path):
    batches, texts = stream_rows()
    src, out, catalog, ckpt = (str(tmp_path / n) for n in ("src", "out", "catalog", "ckpt"))
    schema = spark.createDataFrame([], SCHEMA).schema
    run = lambda to: schema_stream.prune_stream(spark, src, schema, to, catalog, ckpt).awaitTermination()
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        if b == 1:                      # the batch fails after its catalog part was written, and runs again
            (tmp_path / "file").write_text("")
            with pytest.raises(StreamingQueryException):
                run(str(tmp_path / "file"))
            assert (tmp_path / "catalog" / "epoch=1").exists()
        run(out)
    whole = spark.createDataFrame([r for rows in batches for r in rows], SCHEMA)
    want = schema_ops.prune_schemas(whole, *schema_stream.fixed.PRUNE_EVAL)
    got = schema_stream.read_epochs(spark, out)
    key = lambda df: sorted(((r["ex_id"], r["pruned_schema"]) for r in df.collect()), key=repr)
    assert key(got) == key(want) and got.count() == 60
    assert got.filter(F.col("prompt").isNull()).count() == 0
    ids = [r["schema_id"] for r in schema_stream.read_epochs(spark, catalog).select("schema_id").collect()]
    assert len(ids) == len(set(ids)) == len({t or "" for t in texts})
    assert sorted(p.name for p in (tmp_path / "out").glob("epoch=*")) == ["epoch=0", "epoch=1", "epoch=2"]
    run(out)                            # nothing new: nothing changes
    assert schema_stream.read_epochs(spark, out).count() == 60


def test_files_per_batch(spark, tmp_path):
    batches, _ = stream_rows()
    src, out, catalog, ckpt = (str(tmp_path / n) for n in ("src", "out", "catalog", "ckpt"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    schema_stream.prune_stream(spark, src, spark.createDataFrame([], SCHEMA).schema, out, catalog, ckpt, files_per_batch=1).awaitTermination()
    assert len(list((tmp_path / "out").glob("epoch=*"))) == 3
    assert schema_stream.read_epochs(spark, out).count() == 60


# --- score sketches -------------------------------------------------------

LONG = "run int, variant string, label string, score double"


def test_merged_sketches_keep_their_bound(spark):
    rng = random.Random(11)
    rows = [(i % 5, "v", "uniform", rng.random()) for i in range(30_000)] + [(i % 2, "v", None, float(i % 3)) for i in range(9_000)]
    rows += [(i % 5, "w", "skewed", rng.random() ** 8) for i in range(20_000)] + [(0, "w", "one", 0.25), (1, "w", "null", None)]
    long = spark.createDataFrame(rows, LONG)
    merged = score_sketch.merge_score_sketches(score_sketch.score_sketches(long, "run"))
    found = score_sketch.sketch_quantiles(merged, low=0, median=0.5, high=1)
    got = {(r["variant"], r["label"]): r for r in found.collect()}
    by = {}
    for _, v, l, s in rows:
        by.setdefault((v, l), []).append(s)
    assert {k: r["n"] for k, r in got.items()} == {k: len(x) for k, x in by.items()}
    assert all((r["low"], r["high"]) == (min(by[k]), max(by[k])) for k, r in got.items() if k != ("w", "null"))
    assert got["w", "null"]["median"] is None and got["w", "one"]["median"] == 0.25
    errors = {(r["variant"], r["label"]): r["rank_error"] for r in score_sketch.rank_errors(long, found, "median", 0.5).collect()}
    assert set(errors) == set(by) - {("w", "null")} and max(errors.values()) <= score_sketch.RANK_ERROR
    wrong = found.withColumn("median", F.lit(0.9))
    off = {(r["variant"], r["label"]): r["rank_error"] for r in score_sketch.rank_errors(long, wrong, "median", 0.5).collect()}
    assert off["v", "uniform"] == pytest.approx(0.4, abs=0.02) and off["v", None] > 0.1
    stored = score_sketch.score_sketches(long).select(F.max(F.length("sketch"))).first()[0]
    assert stored < 40_000


def test_sketch_of_nothing(spark):
    long = spark.createDataFrame([], LONG)
    assert score_sketch.sketch_quantiles(score_sketch.merge_score_sketches(score_sketch.score_sketches(long)), m=0.5).count() == 0
