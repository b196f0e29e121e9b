import math

import duckdb
import numpy as np
import pytest

from tessera import fixed
from tessera.plans.oracle import ORACLE
from tessera.plans.queries import QUERIES

from tessera.operators import retrieve

VECTORS = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 2.0]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]),
           (7, [2.0, 0.0]), (8, [1.0, None])]


def test_top_k_by_brute_force(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [0.0, 0.0]), (13, None), (14, [1.0, None])], df.schema)
    got = {}
    for r in retrieve.cosine_top_k_of(df, asked, k=2, threshold=0.3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["similarity"]))
    assert {q: sorted(x) for q, x in got.items()} == {10: [(1, 0, 1.0), (2, 7, 1.0)], 11: [(1, 2, 1.0)]}
    near = retrieve.cosine_top_k_of(df, asked.filter("vec_id = 10"), k=9).collect()
    assert {r["vec_id"]: r["similarity"] for r in near}[1] == round(0.9 / math.hypot(0.9, 0.1), 6) and len(near) == 3


def test_repeated_and_null_query_ids(spark):
    """Each query row has k places of its own."""
    df = spark.createDataFrame(VECTORS[:4], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [0.0, 3.0]), (None, [-2.0, 0.0])], df.schema)
    got = sorted(((r["query_id"], r["rank"], r["vec_id"]) for r in retrieve.cosine_top_k_of(df, asked, k=1).collect()), key=repr)
    assert got == sorted([(1, 1, 0), (1, 1, 2), (None, 1, 2), (None, 1, 3)], key=repr)


def test_corpus_is_not_shuffled(spark, capsys):
    """The search itself has no Exchange, however many blocks there are."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    rows = retrieve._usable(df, "vec_id", "embedding")
    retrieve._search_block(rows, [(0, [1.0, 0.0])], 2, 0.3).explain()
    assert "Exchange" not in capsys.readouterr().out
    one, many = (sorted(tuple(r) for r in retrieve.cosine_top_k_of(df, df, block_rows=n).collect()) for n in (4096, 3))
    assert one == many


def test_bound_keeps_all_that_count():
    """Blocks with the bound against plain cosines, over many batches."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(9, 6)), rng.normal(size=(300, 6))
    block = retrieve.Block(pa.array(range(9)), q, retrieve.in_order(q, q), 4, 0.2)
    for at in range(0, 300, 16):
        part = c[at:at + 16]
        block.add(pa.array(range(at, at + len(part))), part, retrieve.in_order(part, part))
    got = {}
    for i, j in zip(block.query.tolist(), block.row.tolist(), strict=True):
        got.setdefault(i, set()).add(j)
    cosine = (q @ c.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
    assert got == {i: {int(j) for j in np.argsort(-cosine[i])[:4] if cosine[i, j] >= 0.2} for i in range(9)}


def test_queries_of_any_number(spark, tmp_path):
    """Over a thousand queries, null ones and copies, against the oracle."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(22_000, 4)).round(2).tolist()
    rows = [(i, None if i in (40, 41) else v[i % 21_900]) for i in range(len(v))]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(path)
    got = [tuple(r) for r in QUERIES["rt_cosine_topk"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert sorted(got) == sorted(con.execute(ORACLE["rt_cosine_topk"]).fetchall())


def test_blocks_widths_and_odd_queries(spark):
    df = spark.createDataFrame(VECTORS + [(9, [float("nan"), 1.0]), (None, [3.0, 0.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in retrieve.cosine_top_k_of(df.repartition(3), df, k=3, threshold=fixed.SIMILARITY_THRESHOLD, block_rows=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["similarity"]))
    cosine = round(0.9 / math.hypot(0.9, 0.1), 6)
    first = [(1, 0, 1.0), (2, 7, 1.0), (3, None, 1.0)]
    assert {q: sorted(x) for q, x in got.items()} == {
        0: first, 7: first, None: first, 1: [(1, 1, 1.0), (2, 0, cosine), (3, 7, cosine)], 2: [(1, 2, 1.0)],
        3: [(1, 3, 1.0)], 6: [(1, 6, 1.0)]}
    assert retrieve.cosine_top_k_of(df, df.limit(0)).count() == 0
