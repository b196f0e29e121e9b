"""SimHash and embedding near-duplicates against brute force."""

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import components, embedding_dedup as emb, queries, simhash

SF = "/root/testdata/sf0.001"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- components -----------------------------------------------------------

@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40))))
def test_stars(links):
    a, b = (np.array([x[k] for x in links], dtype=np.int64) for k in (0, 1))
    got = dict(zip(*(x.tolist() for x in components.stars(a, b)), strict=True)) if links else {}
    want = roots({x for link in links for x in link}, links)
    assert got == {n: r for n, r in want.items() if n != r}


def test_connected(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (150, 2))] + [(500, 500 + i) for i in range(90)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected(df.repartition(3)).collect()}
    want = roots({x for link in links for x in link}, links)
    assert got == {n: r for n, r in want.items() if n in {x for a, b in links if a != b for x in (a, b)}}
    assert components.connected(df.limit(0)).count() == 0


# --- SimHash --------------------------------------------------------------

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def plain_components(prints):
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if bin(prints[a] ^ prints[b]).count("1") <= 2]
    return roots(ids, links)


def test_simhash_whole_table(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    prints = {d: plain_fingerprint(t) for d, t in docs.items()}
    want = plain_components(prints)
    rows = queries.op9_simhash(spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == \
        {d: (f"{prints[d]:016x}", want[d]) for d in docs}


TEXTS = [None, "", " \t", "One", "one", "one two", "A B C", "a\x0bb\x0cc", "É é x y", "a b c d", "x\x1cy z"] + ["the same text again"] * 3


def test_simhash_odd_rows(spark):
    rows = [(i, t, "fp", 7) for i, t in enumerate(TEXTS)] + [(3, "one", "x", 1), (None, "one", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    prints = {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}
    want = plain_components(prints)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["fp"] % 2**64, r["component_id"]) == (prints[r["doc_id"]], want[r["doc_id"]])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0


def test_keep_first_by_row(spark):
    """Texts of one id are rows of their own; copies without an id go."""
    a, b, c = ("one two three four", "five six seven eight nine", "ten eleven twelve and more")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, "quite another text here"), (4, c), (None, a), (None, a), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_first(docs).collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (4, c), (4, "quite another text here"), (None, a), (None, b)], key=repr)
    component = {(r["doc_id"], r["fp"] % 2**64): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert [component[i, plain_fingerprint(t)] for i, t in rows[:6]] == [1, 1, 2, 2, 4, 4]


@pytest.mark.parametrize(("segments", "tile_rows"), [(4, 8192), (4, 3), (8, 5), (2, 100)])
def test_similar_fingerprints(spark, segments, tile_rows):
    rng = np.random.default_rng(segments)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 120, dtype=np.uint64)
    near = base[rng.integers(0, 120, 300)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    near ^= np.uint64(1) << np.uint64(63)
    prints = {i: int(x) for i, x in enumerate(np.unique(np.concatenate([base, near, np.array([0, 2**64 - 1], dtype=np.uint64)])))}
    df = spark.createDataFrame([(i, x - 2**64 if x >= 2**63 else x) for i, x in prints.items()], "node long, fp long")
    found = [tuple(r) for r in simhash.similar_fingerprints(df, 2, segments, tile_rows).collect()]
    assert all(bin(prints[a] ^ prints[b]).count("1") % 2**64 >= 0 for a, b in found)
    assert roots(prints, found) == plain_components(prints)


# --- embeddings -----------------------------------------------------------

def plain_embeddings(rows, cosine=0.9):
    fine = {i: np.array(v, dtype=np.float64) for i, (k, v) in enumerate(rows) if k is not None and v is not None and len(v)
            and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    widths = [len(v) for v in fine.values()]
    width = max(sorted(set(widths)), key=widths.count) if widths else 0
    fine = {i: v / np.abs(v).max() for i, v in fine.items() if len(v) == width}
    links = [(a, b) for a in fine for b in fine if a != b
             and fine[a] @ fine[b] / np.sqrt((fine[a] @ fine[a]) * (fine[b] @ fine[b])) >= cosine]
    n = {i: 0 for i in range(len(rows))}
    for a, _ in links:
        n[a] += 1
    # Components by row, named by their smallest vec_id.
    comp = roots(range(len(rows)), links)
    names = {}
    for i, c in comp.items():
        if rows[i][0] is not None:
            names[c] = min(names.get(c, rows[i][0]), rows[i][0])
    return sorted(((k, n[i], names.get(comp[i]), k == names.get(comp[i])) for i, (k, _) in enumerate(rows)), key=repr)


def check_embeddings(spark, rows, kind="float", **settings):
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], f"vec_id long, embedding array<{kind}>, n_links int")
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in emb.near_duplicates(df, **settings).collect()]
    assert sorted(got, key=repr) == plain_embeddings(rows)


def clustered(rng, n, width, noise):
    centres = rng.normal(size=(max(2, n // 12), width))
    return (centres[rng.integers(0, len(centres), n)] + noise * rng.normal(size=(n, width))).astype(np.float32)


@pytest.mark.parametrize(("width", "noise", "settings"), [
    (64, 0.25, {}), (8, 0.4, {"cell_rows": 40}), (3, 0.3, {"sample": 20, "most_cells": 50, "cell_rows": 16}),
    (8, 0.02, {"most_cells": 30, "cell_rows": 25})])
def test_embeddings(spark, width, noise, settings):
    rng = np.random.default_rng(width)
    v = clustered(rng, 260, width, noise)
    v = np.concatenate([v, v[:20], v[:20] * 2, np.repeat(v[:1], 30, axis=0)])
    check_embeddings(spark, [(int(i), x.tolist()) for i, x in enumerate(v)], **settings)


def test_embeddings_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [None, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [1e-300, 0.0]), (9, [1e300, 1e299]), (0, [1.0, 0.0]),
            (10, [0.0, 0.0]), (11, None), (12, [1.0, -0.0])]
    check_embeddings(spark, rows, "double")
    check_embeddings(spark, rows[1:4], "double")
    assert emb.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    got = emb.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    assert sorted(got.collect(), key=repr) == sorted([(4, 0, 4, True), (None, 0, None, True)], key=repr)


def test_embeddings_of_repeated_ids(spark, tmp_path):
    """Different vectors of one id, of one width, link and group by themselves;
    the oracle agrees by row."""
    a, b, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.1, 0.0]
    rows = [(5, a), (5, b), (6, near), (7, near), (3, b), (5, a), (9, [0.0, 0.0, 1.0]), (9, near)]
    check_embeddings(spark, rows)
    rng = np.random.default_rng(8)
    v = clustered(rng, 200, 6, 0.25)
    rows = [(int(i), x.tolist()) for i, x in zip(rng.integers(0, 70, 200), v, strict=True)]
    check_embeddings(spark, rows, cell_rows=30, most_cells=40)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in queries.op3_embeddings(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(queries.ORACLE["op3_embeddings"]).fetchall())


def test_embeddings_of_several_widths(spark, tmp_path):
    """Near vectors of every width, against the oracle; one id has two widths."""
    rng = np.random.default_rng(5)
    v = [x.tolist() for n, width in ((80, 8), (60, 3), (2, 5)) for x in clustered(rng, n, width, 0.2)]
    v += v[80:90] + v[140:141]
    rows = [(int(i), x) for i, x in zip(rng.permutation(len(v)), v, strict=True)]
    path = str(tmp_path / "embeddings.parquet")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(path)
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in queries.op3_embeddings(spark, str(tmp_path)).collect()]
    sql = queries.ORACLE["op3_embeddings"]
    con, want = duckdb.connect(), []
    for width in (8, 3, 5):     # DuckDB may take the cosine of a pair before it compares the lengths
        con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet') WHERE len(embedding) = {width}")
        want += con.execute(sql).fetchall()
    assert sorted(got) == sorted(want)
    assert sum(n > 0 for i, n, _, _ in got if len(dict(rows)[i]) == 3) > 20
    both = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (1, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], df.schema)
    assert sorted(tuple(r) for r in emb.near_duplicates(both).collect()) == [
        (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_embeddings_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in queries.op3_embeddings(spark, SF).collect()]
    assert sorted(got, key=repr) == plain_embeddings(rows)


def test_cover_tree():
    rng = np.random.default_rng(0)
    points = emb.unit(clustered(rng, 400, 5, 0.2).astype(np.float64))
    tree = emb.CoverTree(points)
    for k, level in enumerate(tree.levels):
        assert sorted(level["members"].tolist()) == list(range(400))
        for node, c in enumerate(level["centre"]):
            own = level["members"][level["start"][node]:level["start"][node + 1]]
            far = np.linalg.norm(points[own] - points[c], axis=1).max()
            assert c in own and abs(far - level["radius"][node]) < 1e-3 and far <= 2.0 ** (1 - k) + 1e-3
        if k:
            assert set(tree.levels[k - 1]["centre"]) <= set(level["centre"])     # nested
    x, y = emb.near_nodes(tree, tree, 0.4472)
    assert len(x) < len(tree.levels[-1]["centre"]) ** 2                          # something is pruned
