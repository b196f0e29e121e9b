"""Quality classifier by Bradley-Terry pairwise ranking (operator 2).

Each pair of a good and a poor document says "the first is better".  The score
of a document is linear in its features, and a pair's probability is the
logistic function of the difference of the two scores, so fitting is logistic
loss on feature differences, without an intercept.  Pairs fix scores up to a
shift; the shift comes from a quantile: the score below which as large a share
of the labelled sample lies as is labelled poor.  A reported score is the
logistic function of the distance to that threshold, so 0.5 is the threshold.

The model is fitted on the driver from a bounded sample of labelled rows
(``sample`` documents, taken by a hash of their ids) and ``pairs`` pairs of
them; only fixed-width feature rows of that sample reach the driver.  Scoring
is a column over whole texts.

Defined results: null and empty texts score as a text of no features; every
input row gives one row, repeated ids included; contradictory labels of one id
count as the lower one; with no good or no poor label, nothing is learned and
every score is 0.5 (kept); an empty table gives an empty result.  Only doc_id
and text of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import bounded_batches, held_out, one_label_per_document, one_text_per_document
from tessera.llm.features import WIDTH, shape, shape_column, sigmoid


@dataclass
class Ranking:
    """Linear scores with the threshold at 0."""

    weights: np.ndarray
    shift: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Row by row in one order of summands, so that a text scores the same
        in any batch; a matrix product does not."""
        return sigmoid((x.astype(np.float64) * self.weights).sum(axis=1) - self.shift)


def fit_pairs(x: np.ndarray, better: np.ndarray, pairs: int, ridge: float, seed: int = 7) -> Ranking:
    """Bradley-Terry scores by Newton's method on sampled (good, poor) pairs."""
    good, poor = np.flatnonzero(better == 1), np.flatnonzero(better == 0)
    if not len(good) or not len(poor):
        return Ranking(np.zeros(x.shape[1]), 0.0)
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0) + 1e-3
    z = (x / scale).astype(np.float64)
    d = z[rng.choice(good, pairs)] - z[rng.choice(poor, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = sigmoid(d @ w)
        gradient = d.T @ (p - 1) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    ranked = np.sort(z @ w)
    at = len(poor)
    return Ranking(w / scale, float((ranked[at - 1] + ranked[min(at, len(ranked) - 1)]) / 2))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, hidden: int, sample: int) -> DataFrame:
    """(doc_id, label, text) of at most ``sample`` labelled documents outside
    the hidden fold, chosen by a hash of their ids, one text of each."""
    known = one_label_per_document(labels, column).where(~held_out("doc_id", folds, hidden))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "doc_id"))  # at most ``sample`` ids
    return one_text_per_document(rows, "doc_id", "label")


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 8000, pairs: int = 20_000, ridge: float = 1e-3) -> Ranking:
    bounded_batches(docs)
    rows = labelled_sample(docs, labels, "quality", 3, 1, sample)
    got = rows.select("doc_id", "label", shape_column(F.col("text")).alias("x")).toPandas().sort_values("doc_id")
    if not len(got):
        return Ranking(np.zeros(WIDTH), 0.0)
    return fit_pairs(np.stack(got["x"].to_numpy()), got["label"].to_numpy(), pairs, ridge)


def quality_score(text: Column, model: Ranking) -> Column:
    """Score of a text (double, 0 to 1)."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [model.scores(np.stack([shape(t.as_py()) for t in batch[at:at + 256]])) for at in range(0, len(batch), 256)]
            yield pa.array(np.concatenate(parts or [np.zeros(0)]).astype(np.float64))

    return score(F.coalesce(text, F.lit("")))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit_quality(docs, labels)
    return (docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"),
                        quality_score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
