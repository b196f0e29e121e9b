"""Toxicity by non-negative positive-unlabelled learning (operator 4).

Confirmed toxic documents are the positives; documents taken whatever their
label are the unlabelled set, which holds toxic ones too.  With the class prior
pi, the risk of calling the clean part toxic is the unlabelled risk less pi
times the positives' risk of being called clean; that difference estimates a
risk and so may not fall below zero.  Training descends
pi * R(positive, +) + max(0, R(unlabelled, -) - pi * R(positive, -)) with
logistic loss, and when a batch's difference is negative, steps to raise that
part instead, as in the published algorithm; its tolerance ``beta`` covers the
difference between the prior and the toxic share of the unlabelled sample.

The features are single terms (words and word stems, at least once, twice or
three times in a text) that the positives hold significantly more often than the unlabelled texts, by half the
inverse prior or more (a term of toxic texts only is as much more frequent as
the inverse prior).  Terms are
counted in Spark; the model is fitted on the driver from bounded samples
(``positives`` and ``unlabelled`` documents, by a hash of their ids).  The
prior is the toxic share of the labels outside the hidden fold.

Defined results: null and empty texts hold no term and score as such; every
input row gives one row, repeated ids included; contradictory labels of one id
count as the lower one; without positives nothing is learned and every score is
0; an empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import bounded_batches, held_out, materialize, one_label_per_document, one_text_per_document
from tessera.llm.features import LETTERS, STEMS, marked, sigmoid, telling_terms


@dataclass
class TermModel:
    """Logistic model over the presence of known terms."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        plain = {t.partition("*")[0] for t in self.weights}
        self.words = frozenset(t for t in plain if not t.endswith("-"))
        self.stems = frozenset(t[:-1] for t in plain if t.endswith("-"))
        self.heads = frozenset(s[:STEMS[0]] for s in self.stems)
        self.sizes = sorted({len(s) for s in self.stems})

    def found(self, text: str) -> set[str]:
        """The model's terms in a text."""
        head, heads, known = STEMS[0], self.heads, self.words
        return self.told(self.in_word(w) for w in LETTERS(text.lower()) if w in known or w[:head] in heads)

    def in_word(self, w: str) -> tuple[str, ...]:
        """The word itself and its stems, as far as the model knows them."""
        own = (w,) if w in self.words else ()
        return own + tuple(w[:k] + "-" for k in self.sizes if len(w) > k and w[:k] in self.stems)

    def in_pretoken(self, pretoken: str) -> tuple[str, ...]:
        """``in_word`` of a pretoken that is a run of letters, after a space or not."""
        w = (pretoken[1:] if pretoken[0] == " " else pretoken).lower()
        if w in self.words or w[:STEMS[0]] in self.heads:
            return self.in_word(w)
        return ()

    def told(self, words: Iterable[tuple[str, ...]]) -> set[str]:
        """The model's terms in a text whose words hold these."""
        counts: dict[str, int] = {}
        for seen in words:
            for term in seen:
                counts[term] = counts.get(term, 0) + 1
        return {t for term, n in counts.items() for t in (marked(term, n) if n > 1 else (term,)) if t in self.weights}

    def score(self, text: str) -> float:
        return float(sigmoid(self.bias + sum(self.weights[t] for t in sorted(self.found(text)))))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05,
             ridge: float = 1e-4, beta: float | None = None, gamma: float = 1.0,
             risks: list[float] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative PU risk's minimiser (Adam over the
    whole sample; the rate falls to a tenth, so that the two kinds of step
    settle).

    A clean risk below -``beta`` is corrected.  It cannot fall below the prior
    times the positives' loss, so the tolerance grows with the prior: by default
    0.9 of it, 0.1 at most.  ``risks`` takes the clean risk of every step."""
    beta = min(0.1, 0.9 * prior) if beta is None else beta
    with_one = lambda x: np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    p, u = with_one(positive), with_one(unlabelled)
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        fp, fu = p @ w, u @ w
        # Logistic loss: l(+) = log(1 + e^-f), l(-) = log(1 + e^f).
        clean_risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if risks is not None:
            risks.append(float(clean_risk))
        clean_gradient = u.T @ sigmoid(fu) / len(u) - prior * (p.T @ sigmoid(fp)) / len(p)
        if clean_risk < -beta:
            gradient = -gamma * clean_gradient
        else:
            gradient = prior * (p.T @ (sigmoid(fp) - 1)) / len(p) + clean_gradient
        gradient[:-1] += ridge * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        step = rate * (1 - 0.9 * t / steps)
        w -= step * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 4000,
                 most_terms: int = 1000) -> TermModel:
    bounded_batches(docs)
    known = one_label_per_document(labels, "toxic").where(~held_out("doc_id", 4, 2))
    by_hash = (F.xxhash64("doc_id", F.lit(13)), F.col("doc_id"))
    share = known.agg(F.avg("label")).first()[0]
    if not share:
        return TermModel({}, -60.0)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    confirmed = known.where("label = 1").orderBy(*by_hash).limit(positives).select("doc_id", F.lit(1).alias("class"))
    anyone = (docs.select("doc_id").where(~held_out("doc_id", 4, 2)).orderBy(*by_hash).limit(unlabelled)
              .select("doc_id", F.lit(0).alias("class")))
    # Both sides are bounded by the sample sizes.
    sample = texts.join(F.broadcast(confirmed.unionByName(anyone).distinct()), "doc_id")
    sample = materialize(one_text_per_document(sample, "doc_id", "class").dropDuplicates(["class", "text"]), "toxicity-sample")
    chosen = telling_terms(sample, 2, [1], most_terms, least=5, lift=0.5 / float(share))[0]
    if not chosen:
        return TermModel({}, float(np.log(share / (1 - share))) if share < 1 else 60.0)
    index = {t: i for i, t in enumerate(chosen)}
    finder = TermModel(dict.fromkeys(chosen, 0.0), 0.0)

    @F.arrow_udf("array<int>")
    def hits(batch: pa.Array) -> pa.Array:
        return pa.array([sorted(index[t] for t in finder.found(x.as_py())) for x in batch], pa.list_(pa.int32()))

    rows = sample.select("doc_id", "class", hits("text").alias("hits")).toPandas().sort_values(["doc_id", "class"])
    x = np.zeros((len(rows), len(chosen)), dtype=np.float32)
    for i, own in enumerate(rows["hits"]):
        x[i, own] = 1
    kind = rows["class"].to_numpy()
    if not (kind == 1).any() or not (kind == 0).any():
        return TermModel({}, -60.0)
    weights, bias = fit_nnpu(x[kind == 1], x[kind == 0], min(float(share), 0.95))
    return TermModel(dict(zip(chosen, weights.tolist(), strict=True)), bias)


def toxicity_score(text: Column, model: TermModel) -> Column:
    """Score of a text (double, 0 to 1)."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.score(t.as_py()) for t in batch], pa.float64())

    return score(F.coalesce(text, F.lit("")))


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit_toxicity(docs, labels)
    return (docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"),
                        toxicity_score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
