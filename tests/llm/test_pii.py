"""Personal data: base spans by plain regular expressions, planted neighbours
that spoil a base match, boosted trees against plain formulas."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import pii, queries

SF = "/root/testdata/sf0.001"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def plain_ok(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
            "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def plain_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if plain_ok(kind, m.group())]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


def check_base(texts, rows):
    for text, r in zip(texts, rows, strict=True):
        want = plain_spans(text)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in want) for k in pii.KINDS], text
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        got = r["spans"].split(",") if r["spans"] else []
        assert set(want) <= set(got)
        assert got == sorted(got, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    df = queries.op13_pii(spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in pii.KINDS}, "base_sha256": "string", "spans": "string"}
    rows = df.orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [d["doc_id"] for d in docs]
    check_base([d["text"] for d in docs], rows)


def card(i):
    head = f"4{i:014d}"
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def no_card(i):
    return card(i)[:-1] + str((int(card(i)[-1]) + 1) % 10)


@pytest.fixture(scope="module")
def taught(spark):
    """Texts with single items, decoys, and items that spoil each other."""
    rows = []
    for i in range(60):
        n = 7919 * i
        rows += [f"pay {card(n)} now", f"order {no_card(n)} sent", f"call +1 ({200 + i}) 555-{1000 + i} today", f"host 10.{i}.3.4 up",
                 f'key = "{i:04x}a{card(n)}b"', f"version 900.{i}.3.4 of it", f"to a.{i}@mail.example.com too"]
    rows += [f"x +1 (269) 555-{3000 + i} {card(31 * i)} y" for i in range(20)]
    rows += [f"x {card(17 * i)} {card(19 * i + 5)} y" for i in range(20)]
    rows += [f"x {no_card(17 * i)} {no_card(19 * i + 5)} y" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = pii.prepared(docs)
    return rows, found, pii.fit(found)


def test_spoiled_spans_are_added(spark, taught):
    texts, found, detector = taught
    rows = pii.with_spans(found, detector).select("_row.doc_id", pii.span_list(F.col("spans")).alias("spans")).orderBy("doc_id").collect()
    added = [set(r["spans"].split(",")) - set(plain_spans(t)) - {""} for t, r in zip(texts, rows, strict=True)]
    assert all(set(plain_spans(t)) <= set(r["spans"].split(",")) for t, r in zip(texts, rows, strict=True))
    for text, got in zip(texts[-60:-40], added[-60:-40], strict=True):
        assert got == {f"phone:2:{2 + len('+1 (269) 555-3000')}", f"card:{len(text) - 18}:{len(text) - 2}"}
    for got in added[-40:-20]:
        assert got == {"card:2:18", "card:19:35"}
    assert not any(added[:-60]) and not any(added[-20:])
    assert set(detector.thresholds) == {pii.IP, pii.CARD, pii.PHONE}


def test_redaction(spark, taught):
    _, _, detector = taught
    rows = [("a", f"x +1 (269) 555-3296 {card(5)} y"), ("b", None), ("c", "é a.b@c.example.org, 10.0.0.1!"), ("d", "nothing"), ("e", "")]
    docs = spark.createDataFrame(rows, "spans string, text string")
    got = {r["spans"]: r["text"] for r in pii.redacted(pii.prepared(docs), detector).collect()}
    assert got == {"a": "x [PHONE] [CARD] y", "b": None, "c": "é [EMAIL], [IP]!", "d": "nothing", "e": ""}


ODD = [None, "", "a@b", "a@b.c", "%x@b.c%x@d.e.f", "a@b.c@d.e", "@@a@b.c.", "1.2.3.4.5.6.7.8", "300.1.1.1.1.1.1", "0001.02.3.000255", "1.2.3.0000256",
       "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "+1 (800) 555-0199.", "+1 2 3 4 5 6 7 8 9 0", "++1555555555555", "+1(((((((((2",
       "日本 +1 800 555 0199 \U0001f389 a@b.co 10.0.0.1", "\n4111111111111111\r\n", "+4111111111111111", "1" * 30_000, "a" * 30_000, "a" * 20_000 + "@" + "b" * 9000,
       "1." * 9000, "+" * 5000, "1 " * 9000, "4111111111111111 " * 700, "a@b.c " * 800, "(" * 9000 + "1", "+1" + " " * 9000, "1.1.1.1 " * 700]


def test_odd_rows(spark):
    rows = [(None if i % 7 == 3 else i // 2, t, i, "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind long, spans string")
    got = pii.with_spans(pii.prepared(docs), pii.Detector()).orderBy("_row.kind").collect()
    assert [tuple(r["_row"]) for r in got] == [(i, t, k, x) for i, t, k, x in rows]
    for text, r in zip(ODD, got, strict=True):
        assert r["spans"] == r["base_spans"]
        assert [f"{s['kind_name']}:{s['start']}:{s['end']}" for s in r["spans"]] == plain_spans(text), (text or "")[:60]
    rows = pii.find_personal_data(docs.where("kind < 4 or text is null")).collect()
    assert len(rows) == 4 and {(r["base_sha256"], r["spans"]) for r in rows if r["n_email"] == 0} == {(hashlib.sha256(b"").hexdigest(), "")}
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = pii.with_spans(pii.prepared(docs), pii.Detector())._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_trees():
    """Boosting separates an interaction, columns and numpy agree, and a
    threshold keeps its precision."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (900, 4)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 2] > 7)).astype(float)
    trees = pii.boost(x, y)
    assert ((pii.margins(trees, x) > 0) == (y == 1)).mean() > 0.97
    loss = [np.log1p(np.exp(-np.where(y == 1, 1, -1) * pii.margins(trees[:k], x))).mean() for k in range(len(trees) + 1)]
    assert all(a > b for a, b in zip(loss, loss[1:], strict=False))
    scores, truth = np.array([5, 4, 4, 3, 2, 1.0]), np.array([1, 1, 0, 1, 1, 0.0])
    assert pii.calibrated(scores, truth, 0.75) == 1.5 and pii.calibrated(scores, truth, 0.9) == 4.5
    assert pii.calibrated(scores, 0 * truth, 0.5) is None


def test_tree_columns(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (50, 3)).astype(float)
    trees = pii.boost(x, (x.sum(axis=1) > 12).astype(float))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, f array<double>")
    got = [r["s"] for r in df.orderBy("i").select(sum((pii.tree_column(t, F.col("f")) for t in trees), F.lit(0.0)).alias("s")).collect()]
    assert np.allclose(got, pii.margins(trees, x))


def test_training_sample(spark):
    """The first candidates by hash, copies included, as one sort of all gives them."""
    texts = [f"mail a{i}@b{i % 7}.org or 10.0.{i % 256}.{i} and 10.9.8.{i % 400}" for i in range(300)] + ["see x@y.org, 10.1.2.3 or 10.1.2.999"] * 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.prepared(docs)
    rows = found.select(F.crc32(F.col("_text").cast("binary")).alias("row"),
                        F.explode(F.filter("_candidates", lambda c: c["label"].isNotNull())).alias("c")) \
        .select("c.kind", "c.f", "c.label", F.xxhash64("row", "c.start", "c.kind", F.lit(41)).alias("h")).collect()
    rows.sort(key=lambda r: (r["h"], r["kind"], r["label"], r["f"]))
    for sample in (1, 50, 700, len(rows), 10 * len(rows)):
        kinds, x, y = pii.training_sample(found, sample)
        assert kinds.tolist() == [r["kind"] for r in rows[:sample]]
        assert x.tolist() == [list(r["f"]) for r in rows[:sample]] and y.tolist() == [float(r["label"]) for r in rows[:sample]]
    assert len(rows) > 1000


def test_fit_takes_every_candidate(spark):
    """The trees are those of the plain form over all candidates, far more than
    any sample of 20,000, and rare ones of another format count."""
    texts = [f"host 10.{i}.3.{j} up" for i in range(30) for j in range(30)] * 30 + [f"ver 900.{i}.3.{i} x" for i in range(40)] \
        + [f'key "a{card(i)}b" or {no_card(i)}' for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = pii.prepared(docs)
    rows = pii.taught(found)
    assert rows.agg(F.sum("n")).first()[0] > 25_000
    detector = pii.fit(found)
    kinds, x, y = pii.training_sample(found, 1_000_000)
    assert set(detector.trees) == {pii.IP, pii.CARD}
    for kind, trees in detector.trees.items():
        own = kinds == kind
        assert np.allclose(pii.margins(trees, x[own]), pii.margins(pii.boost(x[own], y[own]), x[own]), atol=1e-4)
        assert ((pii.margins(trees, x[own]) >= detector.thresholds[kind]) == (y[own] == 1)).all()
    again = pii.fit(pii.prepared(docs.repartition(7)))
    assert again == detector


def test_calibrated_counts():
    scores, n, y = np.array([2.0, 1.0, 0.0]), np.array([98, 2, 9]), np.array([98, 1, 0])
    one = np.repeat(scores, n), np.concatenate([np.arange(m) < k for m, k in zip(n, y, strict=True)]).astype(float)
    assert pii.calibrated(scores, y, 0.99, n) == pii.calibrated(*one, 0.99) == 0.5
