"""Token counts, packing and token files against the libraries themselves."""

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import packing, queries, token_counts, token_file
from tessera.llm.common import tokenizer_file
from tessera.llm.pretokens import IdEncoder

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "\n", "\n\n", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\ta\r\n b", "it's  we'll DON'T",
    "İstanbul ŉ ſ ΑΣ Σ", "J̌ é K ǰ", "x\x00y \x1c z\x85   　w", "<|endoftext|> a<|startoftext|>b </s><s>",
    "a,b;c 12 345 6.7e9 ²½ ①", "日本語 テスト 🎉🎉", "word " * 5000, "▁ ▁▁a", "end\n", "{\r\n}", "‍ à", "ﬁ ｆ",
]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def table_texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return {r[0]: r[1] or "" for r in rows}


@functools.cache
def library(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file(name))


@functools.cache
def processor():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


counter = functools.cache(lambda: token_counts.WholeTokens("piece_bpe_32k.model"))
encoder = functools.cache(IdEncoder)


def pieces(texts):
    return [len(x) for x in processor().encode(texts)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_counts_whole_table(spark, table_texts):
    got = {r["doc_id"]: r for r in queries.op1_token_counts(spark, SF).collect()}
    want = dict(zip(table_texts, pieces(list(table_texts.values())), strict=True))
    assert {k: r["n_tokens"] for k, r in got.items()} == want
    assert all(r["n_bytes"] == len(table_texts[k].encode()) and r["over_limit"] == (want[k] > 4096) for k, r in got.items())


def test_counts_odd_texts(spark):
    got = [r["n_tokens"] for r in token_counts.count_tokens(documents(spark, ODD)).orderBy("doc_id").collect()]
    assert got == pieces([t or "" for t in ODD])


def test_shortcut_is_taken(spark):
    fresh = token_counts.WholeTokens("piece_bpe_32k.model")
    assert fresh.separable and len(fresh.whole) > 10_000
    assert fresh.count(["the of and"]) == [3] and fresh.merged.keys() == fresh.whole.keys()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'sST .\n\té1₂ſİß!<|>")) | st.characters(exclude_categories=["Cs"]), max_size=30)))
def test_any_text(texts):
    assert counter().count(texts) == pieces(texts)
    for name, rule in (("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder(name, rule).encode(texts)]
        assert got == [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
        assert encoder(name, rule).count(texts) == [len(x) for x in got]


@pytest.mark.parametrize(("name", "rule"), [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_ids_of_table(table_texts, name, rule):
    texts = [t or "" for t in ODD] + list(table_texts.values())
    got = [np.frombuffer(x, "<u4").tolist() for x in IdEncoder(name, rule).encode(texts)]
    assert got == [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, ids_of, capacity=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids_of.keys()
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids_of[d])
            assert r["ids_crc32"] == crc(ids_of[d][at:at + r["length"]])
            at += r["length"]
        assert at == len(ids_of[d])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return sum(len(x) for x in ids_of.values()), len(by_seq)


def test_packing_whole_table(spark, table_texts):
    t = library("byte_bpe_50k.json")
    ids = {d: t.encode(x, add_special_tokens=False).ids + [1] for d, x in table_texts.items()}
    tokens, sequences = check_packing(queries.op5_packing(spark, SF).collect(), ids)
    assert sequences == -(-tokens // 2048)


def test_packing_odd_texts(spark):
    t = library("byte_bpe_50k.json")
    docs = documents(spark, ODD)
    rows = packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(rows, {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(ODD)})
    assert packing.pack_documents(docs.limit(0)).count() == 0
    again = docs.where("doc_id = 3")
    assert packing.pack_documents(again.union(again)).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=60), st.integers(1, 32))
def test_place(lengths, capacity):
    rows = packing.place(lengths, capacity, 1.0, 0.1)
    used = {}
    for doc, start, n, seq, offset in rows:
        assert n > 0
        used.setdefault(seq, []).append((offset, n))
    for spans in used.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
        assert spans[-1][0] + spans[-1][1] <= capacity
    assert len(used) == -(-sum(n % capacity for n in lengths) // capacity) + sum(n // capacity for n in lengths)
    for d, n in enumerate(lengths):
        own = sorted((s, m) for doc, s, m, _, _ in rows if doc == d)
        assert [s for s, _ in own] == np.cumsum([0] + [m for _, m in own])[:-1].tolist() and sum(m for _, m in own) == n


def test_place_balances_cost():
    rows = packing.place([8, 8, 1, 1, 1, 1], 10, 1.0, 1.0)
    cost = {}
    for _, _, n, seq, _ in rows:
        cost[seq] = cost.get(seq, 0) + n + n * n
    assert len(cost) == 2 and max(cost.values()) == min(cost.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300))))
def test_coding_round_trip(documents):
    coded = [token_file.encode_values(np.array(d, dtype="<u4")) for d in documents]
    control, data = (b"".join(c[k] for c in coded) for k in (0, 1))
    assert token_file.decode_values(control, data, [len(d) for d in documents]).tolist() == [x for d in documents for x in d]


def test_token_file_whole_table(spark, table_texts):
    t = library("word_bpe_49k.json")
    rows = {r["doc_id"]: r for r in queries.op6_token_file(spark, SF).collect()}
    at = 0
    for d in sorted(table_texts):
        ids = t.encode(table_texts[d], add_special_tokens=False).ids + [2]
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(rows) == len(table_texts)


def test_token_file_odd_texts(spark, tmp_path):
    t = library("word_bpe_49k.json")
    docs = documents(spark, ODD)
    docs = docs.union(docs.where("doc_id = 6")).union(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    token_file.write_token_file(docs, str(tmp_path / "f"))
    rows = token_file.read_token_file(spark, str(tmp_path / "f")).orderBy("start").collect()
    want = [x for i, x in enumerate(ODD) for _ in range(1 + (i == 6))] + [ODD[6]]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == \
        [t.encode(x or "", add_special_tokens=False).ids + [2] for x in want]
    sizes = spark.read.parquet(str(tmp_path / "f/vocabulary")).orderBy("rank").collect()
    assert [r["rank"] for r in sizes] == list(range(len(sizes)))
    assert [r["occurrences"] for r in sizes] == sorted((r["occurrences"] for r in sizes), reverse=True)


def test_token_file_empty(spark, tmp_path):
    token_file.write_token_file(documents(spark, ["x"]).limit(0), str(tmp_path / "f"))
    assert token_file.read_token_file(spark, str(tmp_path / "f")).collect() == []


def test_other_splitting_rules_go_to_the_library(tmp_path):
    """A vocabulary file whose rules are not the stated ones is not split here."""
    import json

    from tessera.llm import pretokens
    from tessera.llm.common import tokenizer_file
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        content = json.load(f)
    assert pretokens.plain_rule_holds(content, "bytes") and not pretokens.plain_rule_holds(content, "words")
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        assert pretokens.plain_rule_holds(json.load(f), "words")
    content["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(content), encoding="utf-8")
    from tokenizers import Tokenizer
    texts = ["two words", "", "again, two words"]
    want = [e.ids for e in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in pretokens.IdEncoder(str(path), "bytes").encode(texts)]
    assert got == want


SIGNS = [chr(k) for k in range(128)] + list("ÀßéÿĀİıſ×÷ƀ\x85\xa0日é") + ["'s", "'Re", "'ll", " ", "  ", "\n", "the", "The ", "12", "<|endoftext|>"]


@pytest.mark.parametrize(("name", "rule"), [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_columns_are_split_as_the_pattern_splits_texts(table_texts, name, rule):
    """All texts of a column at once give what each text gives by itself."""
    import random

    import pyarrow as pa

    from tessera.llm import pretokens
    rng = random.Random(6)
    letters = "".join(map(chr, range(0xC0, 0x180)))
    texts = [t or "" for t in ODD] + ["".join(rng.choices(SIGNS, k=rng.randrange(12))) for _ in range(3000)] + list(letters)
    texts += [rng.choice([" ", "", "\n"]).join(rng.choices(["'", "'s", "'ve", "x", "Ré", "7", "!", "\t", ""], k=6)) for _ in range(3000)]
    plain = pretokens.plain_texts(pa.array(texts), ["<|endoftext|>"])
    whole = encoder(name, rule).beyond.__self__
    assert plain.tolist() == [not whole.search(t) and "<|endoftext|>" not in t for t in texts]
    split = [t for t, own in zip(texts, plain, strict=True) if own]
    found = pretokens.Pieces(pa.array(["-", *split]).slice(1), rule)
    find = encoder(name, rule).find
    for t, a, b, cut in zip(split, found.ends[:-1], found.ends[1:], found.cut, strict=True):
        own, want = [found.distinct[k] for k in found.of[a:b]], find(t.lower() if rule == "words" else t)
        assert [x for x in own if rule == "bytes" or x[0] not in pretokens.SPACES_DROPPED] == want
        assert cut == any(x in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d") for x in want)
    texts += list(table_texts.values())
    own = IdEncoder(name, rule, 50)         # forgets all the time
    column = pa.array(["-", *texts]).slice(1)
    want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    got, sizes = [], []
    for at, n in pretokens.text_slices(column, 5000):
        values, lengths = own.encode_column(column.slice(at, n), 2)
        got += [x.tolist() for x in np.split(values, np.cumsum(lengths))[:-1]]
        sizes += own.measure_column(column.slice(at, n))[0]
    assert got == [x + [2] for x in want] and sizes == [len(x) for x in want]
    none = pa.array([], pa.string())
    assert [len(x) for x in own.encode_column(none, 2)] == [0, 0] and own.measure_column(none) == ([], [])
    assert list(pretokens.text_slices(none)) == []
    assert list(pretokens.text_slices(pa.array(["", "aaaa", "b", "c", ""]), 2)) == [(0, 1), (1, 1), (2, 3)]
