"""Learned operators: gradients and risks against plain formulas, held-out
accuracy on the tables, defined results for odd rows."""

import warnings
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tokens import library

from tessera.llm import features, language, mixing, quality, queries, toxicity
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double, predicted int, found string, held_out string"
ODD = [(1, None, None), (2, "", "en"), (3, " \n ", "de"), (4, "1234 !!! ??", "en"), (5, "x", None), (None, "no id here", "en"),
       (6, "the same words " * 30_000, "en"), (7, "日本語 テスト", "ja"), (7, "日本語 テスト", "ja")]


def odd_documents(spark):
    return spark.createDataFrame([(i, t, k, 9.0, 5, "f", "h") for i, t, k in ODD], DOCS)


def label_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


LABELS = [(1, 1, 0, "a"), (2, 0, 1, "b"), (2, 1, 0, "b"), (3, 1, None, "c"), (None, 0, 1, "d"), (4, None, None, "e"),
          (5, 0, 0, "f"), (6, 1, 0, "g"), (7, 0, 1, "h"), (99, 0, 0, "i")]


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def joined(spark, op):
    rows = {r["doc_id"]: r for r in queries.QUERIES[op](spark, SF).collect()}
    known = {}
    for r in table(spark, SF, "labels").collect():
        known[r["doc_id"]] = r
    return rows, known


# --- quality --------------------------------------------------------------

def test_quality_held_out(spark):
    rows, known = joined(spark, "op2_quality")
    assert set(rows) == {r[0] for r in table(spark, SF, "documents").select("doc_id").collect()}
    assert all(r["held_out"] == (fold(d, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
               for d, r in rows.items())
    hidden = [d for d in known if d in rows and rows[d]["held_out"]]
    assert len(hidden) > 100
    assert np.mean([rows[d]["predicted"] == known[d]["quality"] for d in hidden]) >= 0.97


def test_pair_loss_is_minimal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    better = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(int)
    model = quality.fit_pairs(x, better, 3000, 1e-2)
    good, bad = model.scores(x)[better == 1], model.scores(x)[better == 0]
    assert (good[:, None] > bad).mean() > 0.95
    # The threshold is the quantile of the poor share.
    assert abs((model.scores(x) < 0.5).mean() - (better == 0).mean()) < 0.01
    assert (quality.fit_pairs(x, np.ones(200, dtype=int), 10, 1e-2).scores(x) == 0.5).all()
    # The weights are those of plain gradient descent on the same pairs' loss.
    rng, scale = np.random.default_rng(7), x.std(axis=0) + 1e-3
    z = (x / scale).astype(np.float64)
    d = z[rng.choice(np.flatnonzero(better == 1), 3000)] - z[rng.choice(np.flatnonzero(better == 0), 3000)]
    w = np.zeros(5)
    for _ in range(4000):
        w -= 0.2 * (1e-2 * w - d.T @ (1 / (1 + np.exp(d @ w))) / 3000)
    assert np.allclose(model.weights * scale, w, atol=1e-3)


def test_scores_do_not_depend_on_the_batch():
    """A text scores the same alone, among 7 and among 256."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(256, features.WIDTH)).astype(np.float32)
    ranking = quality.Ranking(rng.normal(size=features.WIDTH), 0.3)
    posterior = mixing.Posterior([], np.ones(features.WIDTH + 1), rng.normal(size=(features.WIDTH + 1, 3)))
    rows = np.hstack([x, np.ones((256, 1), dtype=np.float32)])
    for f, data in ((ranking.scores, x), (posterior.probabilities, rows)):
        whole = f(data)
        assert all((f(data[i:i + n]) == whole[i:i + n]).all() for n in (1, 7) for i in range(0, 256, n))


@pytest.mark.parametrize("rows", [LABELS, [], [(1, 1, 0, "a")]])
def test_odd_rows(spark, rows):
    docs, labels = odd_documents(spark), label_rows(spark, rows)
    for made in (quality.classify_quality(docs, labels), toxicity.classify_toxicity(docs, labels)):
        got = made.collect()
        assert made.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(ODD)
        assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
        assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1
    empty = docs.limit(0)
    assert quality.classify_quality(empty, labels).count() == 0 and toxicity.classify_toxicity(empty, labels).count() == 0


def test_shape():
    assert not features.shape("").any()
    for text in ("a", " ", "a b", "word " * 10_000, "é" * 700, "A!! " * 64):
        x = features.shape(text)
        assert x.shape == (features.WIDTH,) and np.isfinite(x).all()
    assert features.shape("a a a a b")[-4] == 0.75
    assert features.terms("Réeuxon 12 a bc") == {"réeuxon", "bc", "rée-", "réeu-", "réeux-", "réeuxo-"}
    assert features.terms("bcde bcd bc bcde bcdx") == {"bcde", "bcde*2", "bcd", "bc", "bcdx", "bcd-", "bcd-*2", "bcd-*3"}


# --- toxicity -------------------------------------------------------------

def test_toxicity_held_out(spark):
    rows, known = joined(spark, "op4_toxicity")
    assert all(r["held_out"] == (fold(d, 4) == 2) and r["predicted"] == (r["score"] >= 0.3) for d, r in rows.items())
    hidden = [d for d in known if d in rows and rows[d]["held_out"]]
    toxic = [rows[d]["score"] for d in hidden if known[d]["toxic"] == 1]
    clean = [rows[d]["score"] for d in hidden if known[d]["toxic"] == 0]
    assert (np.array(toxic)[:, None] > np.array(clean)).mean() > 0.7


def test_nnpu_on_planted_terms():
    rng = np.random.default_rng(2)
    kind = rng.random(4000) < 0.15
    x = (rng.random((4000, 12)) < 0.1).astype(np.float32)
    x[:, 0] = kind & (rng.random(4000) < 0.9)
    x[:, 1] = kind & (rng.random(4000) < 0.5)
    w, bias = toxicity.fit_nnpu(x[kind][:300], x, 0.15)
    score = features.sigmoid(x @ w + bias)
    assert w[0] > 1 and w[0] > np.abs(w[2:]).max()
    assert (score[kind] >= 0.3).mean() > 0.85 and (score[~kind] < 0.3).mean() > 0.95


def test_nnpu_risk_and_correction():
    """The recorded risk is the plain formula's, and a sample that overfits
    drives it below the tolerance, also with few positives."""
    for prior in (0.2, 0.01):
        rng = np.random.default_rng(9)
        p, u = (rng.random((n, 60)) < 0.3 for n in (20, 40))
        p, u = p.astype(np.float32), u.astype(np.float32)
        risks = []
        toxicity.fit_nnpu(p, u, prior, risks=risks)
        f = np.log(prior / (1 - prior))
        assert np.isclose(risks[0], np.log(1 + np.exp(f)) - prior * np.log(1 + np.exp(f)))
        assert any(r < -min(0.1, 0.9 * prior) for r in risks)
        free = []
        toxicity.fit_nnpu(p, u, prior, beta=np.inf, risks=free)
        assert min(free) < min(risks)                   # the correction holds the risk back


def test_samples_are_bounded_in_rows(spark):
    """One id on very many texts gives one row."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    got = quality.labelled_sample(docs, labels, "quality", 3, 99, 10).collect()
    assert sorted((r["doc_id"], r["text"], r["label"]) for r in got) == [(1, "text 0", 1), (2, "other", 0), (3, "", 1)]


def test_found_terms():
    model = toxicity.TermModel({"idiot": 1.0, "réeux-": 2.0, "ach-": 0.5}, -1.0)
    assert model.found("Idiot! réeux RÉEUXON achte ach") == {"idiot", "réeux-", "ach-"}
    twice = toxicity.TermModel({"idiot*2": 1.0, "réeux-*3": 2.0}, -1.0)
    assert twice.found("idiot IDIOT réeuxa réeuxb") == {"idiot*2"} and twice.found("réeuxa réeuxa réeuxb") == {"réeux-*3"}
    assert model.found("") == set() and 0 < model.score("") < 0.5


# --- language -------------------------------------------------------------

def test_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in language.initial(3, 3, rng).items()}
    lengths, label = np.array([6, 4, 1]), np.array([0, 2, 1])
    symbols = rng.integers(0, 256, (6, 3))
    symbols[np.arange(6)[:, None] >= lengths] = language.PAD
    _, got = language.loss_and_gradients({k: v.astype(np.float32) for k, v in p.items()}, symbols, lengths, label)

    def loss(changed):
        prob = language.position_probabilities({k: v.astype(np.float32) for k, v in changed.items()}, symbols, lengths)
        terms = [np.log(prob[t, label[b], b]) for b in range(3) for t in range(lengths[b])]
        return -np.mean(terms)

    for name, value in p.items():
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 7)] + ([(1, int(symbols[0, 0]))] if value.shape[-1] == 257 else []):
            step = np.zeros_like(value)
            step[at] = 1e-2
            want = (loss(p | {name: value + step}) - loss(p | {name: value - step})) / 2e-2
            assert abs(want - got[name][at]) < 2e-3, (name, at)


def test_windows_pool_whole_texts():
    rng = np.random.default_rng(4)
    model = language.LanguageModel(["a", "b"], language.initial(4, 2, rng))
    texts = [b"", b"x", b"word " * 37, bytes(rng.integers(0, 256, 96)), bytes(rng.integers(0, 256, 96 * 5 + 1))]
    got = model.document_probabilities(texts)
    for t, row in zip(texts, got, strict=True):
        total = np.zeros(2)
        for at in range(0, len(t), language.WINDOW):
            s, n = language.windows_of(np.frombuffer(t[at:at + language.WINDOW], dtype=np.uint8))
            total += language.position_probabilities(model.parameters, s[:int(n[0])], n)[:, :, 0].sum(axis=0)
        assert np.allclose(row, total / max(1, len(t)), atol=1e-5)


def test_language_held_out(spark):
    rows = {r["doc_id"]: r for r in queries.op8_language(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(rows) == len(docs)
    hidden = [d for d in docs if fold(d["doc_id"], 5) == 0]
    assert all(rows[d["doc_id"]]["held_out"] == (fold(d["doc_id"], 5) == 0) for d in docs)
    assert np.mean([rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in hidden]) >= 0.97


def test_language_odd_rows(spark):
    docs = odd_documents(spark)
    got = language.identify_language(docs).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = next(t for i, t, _ in ODD if i == r["doc_id"])
        unknown = text is None or not any(c.isalpha() for c in text)
        assert (r["lang_pred"] == "und") == unknown and 0 <= r["score"] <= 1 and (not unknown or r["score"] == 0)
    assert language.identify_language(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- mixing ---------------------------------------------------------------

def plain_rates(n, p, targets):
    """Projected gradient in numpy, on all rows at once; a domain that no row
    may belong to has no target."""
    r = np.ones(len(n))
    wanted = np.where(n @ p > 0, targets, 0.0)
    wanted *= n.sum() / wanted.sum()
    inverse = np.linalg.pinv((p * n[:, None]).T @ p, rcond=1e-9, hermitian=True)
    for _ in range(25):
        residual = (n * r) @ p - wanted
        if np.abs(residual).max() <= 1e-9 * n.sum():
            break
        r = np.maximum(0, r - p @ (inverse @ residual))
    return r


@pytest.mark.parametrize("targets", [[0.2, 0.5, 0.3], [0.98, 0.01, 0.01], [0.0, 0.0, 1.0]])
def test_rates(spark, targets):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.3, 0.2], 300)
    n = rng.integers(0, 500, 300)
    members = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p, strict=True)], "n_tokens long, p0 double, p1 double, p2 double")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        steps, gap = mixing.fit_rates(members, targets)
    said = [w for w in said if "mixing" in str(w.message)]
    assert (gap > mixing.MET) == bool(said)
    rate = mixing.rate_column(steps, [F.col(f"p{k}") for k in range(3)])
    got = np.array([r[0] for r in members.select(rate).collect()])
    assert (got >= 0).all() and np.allclose(got, plain_rates(n.astype(float), p, targets), atol=1e-6)
    if targets == [0.2, 0.5, 0.3]:                       # within what the posteriors allow
        assert np.allclose((n * got) @ p / n.sum(), targets, atol=1e-6) and not said
    else:                                                # closer than the corpus as it is
        assert np.isclose(gap, np.abs((n * got) @ p / n.sum() - targets).max(), atol=1e-9)
        assert targets != [0.0, 0.0, 1.0] or said        # no rates meet it
        assert np.abs((n * got) @ p / n.sum() - targets).max() < 0.3 * np.abs(n @ p / n.sum() - targets).max()


def token_counts(texts):
    encoded = library("byte_bpe_50k.json").encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [len(e.ids) for e in encoded]


def test_mixing_table(spark):
    docs = table(spark, SF, "documents")
    got = queries.op10_mixing(spark, SF).toPandas()
    assert len(got) == docs.count()
    p = got[["p_good", "p_poor", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (got["rate"] >= 0).all()
    n = got["n_tokens"].to_numpy()
    rows = docs.collect()
    assert dict(zip(got["doc_id"], n, strict=True)) == dict(zip([r["doc_id"] for r in rows], token_counts([r["text"] for r in rows]), strict=True))
    share = (n * got["rate"].to_numpy()) @ p / n.sum()
    assert np.allclose(share, list(mixing.TARGETS.values()), atol=1e-6)
    assert (np.abs(got["copies"] - got["rate"]) < 1).all()
    assert abs(got["copies"].sum() - got["rate"].sum()) < 4 * np.sqrt(len(got)) / 2


@pytest.mark.parametrize("rows", [LABELS, [], [(1, 1, 0, "a")]])
def test_mixing_odd_rows(spark, rows):
    docs, domains = odd_documents(spark), mixing.domain_labels(label_rows(spark, rows))
    rates = mixing.mixing_rates(docs, domains)
    got = rates.collect()
    assert len(got) == len(ODD) and all(r["rate"] >= 0 and r["copies"] >= 0 for r in got)
    # A text without spaces has as many tokens as the vocabulary gives it.
    assert sorted(r["n_tokens"] for r in got) == sorted(token_counts([t for _, t, _ in ODD]))
    mixed = mixing.mix_documents(docs, domains)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mixing_rates(docs.limit(0), domains).count() == 0 and mixing.mix_documents(docs.limit(0), domains).count() == 0


def test_domains(spark):
    got = {r["doc_id"]: r["domain"] for r in mixing.domain_labels(label_rows(spark, LABELS)).collect()}
    assert got == {1: 0, 2: 0, 5: 1, 6: 0, 7: 2, 99: 1}


def test_one_split_tells_tokens_and_terms():
    """A text's pre-tokens tell the model's terms; texts whose words are not
    their pre-tokens are left to the words."""
    from tessera.llm.pretokens import IdEncoder
    finder = toxicity.TermModel(dict.fromkeys(["the", "str-", "straß-", "we", "re", "the*2"], 0.0), 0.0)
    encoder = IdEncoder("byte_bpe_50k.json", "bytes", 3)      # forgets all the time
    encoder.watch("terms", finder.in_pretoken)
    plain = ["", "The the_the 12the", "STRAßE straßen Strange,the", "we're re 'the", "\n the\t\tre"]
    odd = ["it'sthe 're", "日本 the", "we're the"]
    for text in plain * 2 + odd:
        n, told = encoder.measure(text)
        assert n == len(encoder.library.encode(text, add_special_tokens=False).ids)
        assert told is None or finder.told(told) == finder.found(text)
        assert (told is None) == (text in odd or "we're" in text)
    assert len(encoder.watched) <= len(encoder.sizes) + len(encoder.sizes.before)


def test_words_of_a_column():
    """Words counted for all texts at once give the same features of form."""
    import random

    import numpy as np
    import pyarrow as pa

    from tessera.llm import features
    rng = random.Random(10)
    texts = ["", " ", "a", " a a", "a\x1ca b\x1c", "a\xa0a a", "a b a\n", "\x0b\x0ca\ta\r\nb", "日本 日本", "a　a", "“a a”"]
    texts += ["".join(rng.choices(["a", "b ", " a", " the", " the", "\n", "\t", "é"], k=rng.randrange(300))) for _ in range(300)]
    found = list(features.words_of(pa.array(["-", *texts]).slice(1)))
    for t, words in zip(texts, found, strict=True):
        assert np.array_equal(features.shape(t, words), features.shape(t))
        if words:
            own = t.split()
            assert (words[0], words[1], words[2].tolist()) == (len(own), len(set(own)), [int(a == b) for a, b in zip(own, own[1:])])
        else:
            assert not t.isascii() or "\x1c" in t
    assert list(features.words_of(pa.array([], pa.string()))) == []
