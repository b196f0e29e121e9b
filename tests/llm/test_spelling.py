"""Spelling variants against a plain version."""

import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(docs, least_count=5):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 6:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def plain_variants(docs, least_count=5):
    n = plain_words(docs, least_count)
    marks = defaultdict(set)        # a word, or the word without one code point
    for w in n:
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            marks[key].add(w)
    near = {w: set() for w in n}
    for family in marks.values():
        for a in family:
            near[a] |= {b for b in family if one_edit(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def as_set(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_one_edit_is_distance_one(spark):
    words = ["abcdef", "abcdeg", "abcde", "xabcdef", "abcdfe", "aaaaaa", "aaaaa", "ébcdef"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in pairs.select("a", "b", F.levenshtein("a", "b", 1).alias("d")).collect():
        assert one_edit(r["a"], r["b"]) == (r["d"] == 1)


def test_whole_table(spark):
    df = queries.op11_spelling(spark, SF)
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert as_set(df) == plain_variants(docs)


FAMILY = "station stations statien statio sttion xstation staation aaaaaa aaaaaaa aaabaa baaaaa aabbaa aaabba statïon".split()


@pytest.mark.parametrize("hot", [2000, 2, 0])
def test_families_and_chains(spark, hot):
    """Counts of a chain of forms, ties, words of repeated letters and letters
    outside ASCII; with a low bound, families are split."""
    times = [625, 125, 25, 5, 5, 25, 24, 300, 60, 12, 60, 7, 5, 5]
    rows = [(i, " ".join([w] * t)) for i, (w, t) in enumerate(zip(FAMILY, times, strict=True))]
    rows += [(100 + i, " ".join(["prefix" + "abcdefghij"[i % 10] + "qrstuvwxyz"[i // 10]] * (5 + i))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_set(spelling.spelling_variants(docs, hot=hot)) == plain_variants(rows)


def test_odd_rows(spark):
    long = "w" * 40_000
    rows = [(1, None), (None, "Wording wordinG WORDING words1wording"), (2, ""), (2, "wording, wording"), (2, "wording, wording"),
            (3, "12 ×÷ 中文 tiny"), (4, " ".join([long, long[1:]] * 5)), (5, "ÉTUDES études " * 6)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert as_set(spelling.spelling_variants(docs)) == plain_variants(rows)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs.where("doc_id = 1")).count() == 0
