"""Consistent weighted sampling: edits by plain Python, likeness against the
generalised Jaccard similarity."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import queries, weighted_sampling as cws

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        out.append(t[:len(t) - half] + texts[(i + 1) % len(texts)][:half])
    return out


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def check(texts, rows):
    """``texts`` in document order and their result rows."""
    after = edited(texts)
    errors = []
    for i, r in enumerate(rows):
        assert r["n_chars"] == len(texts[i])
        assert r["edited_sha256"] == hashlib.sha256(after[i].encode()).hexdigest()
        for got, other in ((r["near_edited"], after[i]), (r["near_next"], texts[(i + 1) % len(texts)])):
            assert 0 <= got <= 1
            if Counter(texts[i].split()) == Counter(other.split()):
                assert got == 1
            else:
                errors.append(got - jaccard(texts[i], other))
    prints = {}
    for t, r in [*zip(texts, (r["fingerprint"] for r in rows), strict=True), *zip(after, (r["edited_fingerprint"] for r in rows), strict=True)]:
        assert len(r) == 8 * 64 and prints.setdefault(t, r) == r
    return np.array(errors)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    df = queries.op7_weighted_sampling(spark, SF)
    assert df.columns == COLUMNS
    rows = df.orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [d["doc_id"] for d in docs]
    errors = check([d["text"] for d in docs], rows)
    # Standard deviation of a mean of 64 samples is at most 1 / 16.
    assert abs(errors.mean()) < 0.02 and np.sqrt((errors ** 2).mean()) < 0.0625


def test_odd_rows(spark):
    rows = [(5, "a b c 日本 🎉é"), (1, None), (9, ""), (-3, "x  y\n\tz x"), (5, "again five"), (7, "a b c 日本 🎉é"),
            (None, "no id"), (8, " \n "), (11, "w " * 4000), (12, "w " * 2000 + "v " * 2000)]
    df = spark.createDataFrame([(i, t, "q", 3) for i, t in rows], "doc_id long, text string, sig string, b int")
    order = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or ""))
    place = {(i, len(t or "")): k for k, (i, t) in enumerate(order)}     # ids repeat, with texts of other lengths
    got = sorted(cws.fingerprint_edits(df).collect(), key=lambda r: place[r["doc_id"], r["n_chars"]])
    assert len(place) == len(rows) and [(r["doc_id"], r["n_chars"]) for r in got] == list(place)
    check([t or "" for _, t in order], got)
    assert cws.fingerprint_edits(df.limit(0)).count() == 0
    one = cws.fingerprint_edits(df.where("doc_id = 11")).first()
    assert one["near_next"] == 1
    assert cws.fingerprint_edits(df.where("doc_id is null")).first()["near_next"] == 1


@pytest.mark.parametrize("ids", [list(range(0, 900, 3)), [0] * 50 + list(range(10**12, 10**12 + 30)), [4]])
def test_ranges(spark, ids):
    df = spark.createDataFrame([(i, str(k)) for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    rows = cws.in_ranges(df, 7).collect()
    own = [r for r in rows if not r["late"]]
    assert sorted(r["doc_id"] for r in own) == sorted(ids)
    order = sorted(own, key=lambda r: r["doc_id"])
    assert [r["b"] for r in order] == sorted(r["b"] for r in own)
    parts = max(r["b"] for r in own) + 1
    for b in range(parts):
        following = min(r["doc_id"] for r in own if r["b"] == (b + 1) % parts)
        assert {r["doc_id"] for r in rows if r["late"] and r["b"] == b} == {following}


def test_native(spark):
    plan = cws.fingerprint_edits(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    executed = plan[plan.index("== Physical Plan =="):]
    assert executed.count("Exchange hashpartitioning") == 1 and "Exchange SinglePartition" not in executed


def test_gamma_quantiles():
    x = cws.gamma_quantiles()
    assert abs(x.mean() - 2) < 0.01 and abs(x.var() - 2) < 0.03
