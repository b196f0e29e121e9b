"""Ranked lexical search against SQL over all documents and a plain version."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import lexical_search as ls, queries

SF = "/root/testdata/sf0.001"


def plain_terms(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [t.translate(lower) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, k=20):
    tf = [(i, Counter(plain_terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    df = Counter(t for _, c in tf for t in c)
    total = sum(sum(c.values()) for _, c in tf)
    rows = []
    for item, text in items:
        got = []
        for doc, c in tf:
            m = 75 + 25 * sum(c.values()) * len(tf) // total
            score = sum(math.floor(1000 * math.log((2 * len(tf) + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in plain_terms(text) if t in c)
            if score > 0:
                got.append((-score, doc is None, doc or 0))
        rows += [(item, rank, None if null else doc, -less) for rank, (less, null, doc) in enumerate(sorted(got)[:k], 1)]
    return sorted(rows, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_whole_table(spark):
    df = queries.op12_lexical_search(spark, SF)
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert as_rows(df) == sorted(con.execute(ls.ORACLE).fetchall(), key=repr)


@pytest.mark.parametrize("width, block", [(1024, 1000), (8, 7), (1, 3)])
def test_any_width_and_block(spark, width, block):
    """Narrow sketches bound loosely, blocks split the items; results stay."""
    docs, items = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "benchmark"))
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 3)
    assert as_rows(ls.search(docs.repartition(5), items, k=3, width=width, block_items=block)) == want


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(3)
    words = [f"w{i}".encode() for i in range(400)]
    items = [(i, sorted((words[j], int(rng.integers(0, 9000))) for j in rng.choice(400, 12, replace=False))) for i in range(5)]
    block = ls.Block(items, 64)
    docs = [Counter(words[int(400 * x * x)] for x in rng.random(int(rng.integers(1, 60)))) for _ in range(600)]
    import pyarrow as pa
    freqs = [np.fromiter(c.values(), dtype=np.int64) for c in docs]
    part = pa.record_batch([pa.array(range(600)), pa.array([sum(c.values()) for c in docs]), pa.array([list(c) for c in docs], pa.list_(pa.binary())),
                            pa.array([f.tolist() for f in freqs], pa.list_(pa.int32())),
                            pa.array([ls.fold_frequencies(list(c), f, 64).tobytes() for c, f in zip(docs, freqs, strict=True)], pa.binary())],
                           names=["doc_id", "n", "terms", "freqs", "sketch"])
    total = sum(sum(c.values()) for c in docs)
    search = ls.Search(block, 4, 600, total)
    search.add(part)
    for at, (_, terms) in enumerate(items):
        exact = []
        for d, c in enumerate(docs):
            m = 75 + 25 * sum(c.values()) * 600 // total
            exact.append(sum(w * int(ls.impacts(c[t], m)) for t, w in terms if t in c))
        m = np.array([75 + 25 * sum(c.values()) * 600 // total for c in docs])
        sketches = np.stack([ls.fold_frequencies(list(c), f, 64) for c, f in zip(docs, freqs, strict=True)])
        assert (search.bounds(sketches, m)[:, at] >= exact).all()
        assert [(-s, d) for s, _, d in search.best[at]] == sorted(((s, d) for d, s in enumerate(exact) if s), key=lambda x: (-x[0], x[1]))[:4]
    assert search.scored < 5 * 600 / 2      # at random order half of all pairs and more would be scored


def test_frequencies_beyond_the_sketch(spark):
    rows = [(1, "a " * 70_000), (2, "a " * 70_000 + "b"), (3, "b a"), (4, "a")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "a b b")], "item_id long, text string")
    assert as_rows(ls.search(docs, items)) == plain_search(rows, [(1, "a b b")])


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..., !"), (4, "Word Été 中文 x"), (4, "word again"), (None, "word \U0001f389 again"), (5, "word again"), (6, "word again")]
    items = [(1, "WORD"), (1, "again again"), (None, "中文"), (2, None), (3, ""), (4, "nowhere"), (5, "\U0001f389 word"), (1, "WORD")]
    d = spark.createDataFrame([(i, t, 0, "r") for i, t in docs], "doc_id long, text string, score int, item string")
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, terms string")
    assert as_rows(ls.search(d, q)) == plain_search(docs, items)
    assert as_rows(ls.search(d, q, k=2)) == plain_search(docs, items, 2)
    assert ls.search(d.limit(0), q).count() == 0 and ls.search(d, q.limit(0)).count() == 0
    assert ls.search(d.where("doc_id < 3"), q).count() == 0
    index = ls.build_index(d)
    assert as_rows(ls.search(d, q, index=index)) == plain_search(docs, items)
