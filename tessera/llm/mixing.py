"""Mixing to target weights with soft domain membership (operator 10).

A softmax classifier, fitted on a labelled table, gives every document its
posterior over domains.  Each document gets a nonnegative rate (expected number
of copies) such that the domains' expected token totals, the sums of
rate * tokens * posterior, match the targets in least squares.  Tokens are the
ids of a public vocabulary, by default the one that packing uses, so the shares
hold for the sequences that training sees.

The rates are found by projected gradient from rate 1 for every document.  With
M the tokens-weighted second moment of the posteriors, the residual is measured
by M's inverse and the rates by their tokens; then the gradient step of a
document is the product of its posterior and one short vector that is the same
for all documents, and a step of length 1 is exact as long as no rate meets
zero.  One iteration is one aggregate over a narrow table (domains many sums);
only that vector goes back, and a document's rate is a fold over the vectors so
far.  The job needs no state per document besides its posterior.

Copies are whole: the rate plus a fixed pseudo-random share of the document's
id, rounded down, so their expectation is the rate.

Defined results: null and empty texts have no tokens and no features, and get a
rate all the same; repeated ids are mixed row by row; contradictory labels of
one id count as the lower domain number; with fewer than two labelled domains
the posteriors are the label shares (all rates are then equal); domains that no
label names have posterior 0 and are left out of the fit; an empty table gives
an empty result.  Only doc_id and text are read; in ``mix_documents`` all other
columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import bounded_batches, materialize, one_text_per_document
from tessera.llm.features import WIDTH, shape, telling_terms, words_of
from tessera.llm.packing import KEPT
from tessera.llm.toxicity import TermModel

#: Domain numbers and their share of the mixed corpus' tokens.
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.90, "poor": 0.06, "toxic": 0.04}

#: Vocabulary file whose ids are counted, and its splitting rule.
TOKENIZER, RULE = "byte_bpe_50k.json", "bytes"

#: Targets count as met when every domain's total is this near, as a share of
#: all tokens.
MET = 1e-3


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the ``labels`` table: toxic, else poor, else good."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    return known.groupBy("doc_id").agg(F.min(domain).alias("domain"))


@dataclass
class Posterior:
    """Softmax classifier over text form and telling terms."""

    terms: list[str]
    scale: np.ndarray
    weights: np.ndarray       # (features + 1, domains)

    def __post_init__(self) -> None:
        self.index = {t: i for i, t in enumerate(self.terms)}
        self.finder = TermModel(dict.fromkeys(self.terms, 0.0), 0.0)

    def features(self, text: str, told: list[tuple[str, ...]] | None = None,
                 words: tuple[int, int, np.ndarray] | None = None) -> np.ndarray:
        """Features of a text; ``told``: what its words hold, where that is
        known; ``words``: as ``words_of`` gives them."""
        x = np.zeros(WIDTH + len(self.terms) + 1, dtype=np.float32)
        x[:WIDTH] = shape(text, words)
        for t in self.finder.found(text) if told is None else self.finder.told(told):
            x[WIDTH + self.index[t]] = 1
        x[-1] = 1
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        # Summed row by row: a matrix product depends on the rows of a batch.
        z = (x / self.scale).astype(np.float64)
        logits = np.stack([(z * w).sum(axis=1) for w in self.weights.T.astype(np.float64)], axis=1)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Multinomial logistic weights by accelerated gradient descent."""
    z = x.astype(np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    rate = 1 / (0.5 * float(np.linalg.norm(z.T @ z / len(z), 2)) + ridge)
    w = v = np.zeros((x.shape[1], classes), dtype=np.float32)
    for t in range(steps):
        logits = z @ v
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        after = v - rate * (z.T @ (p - target) / len(z) + ridge * v)
        v = after + (t / (t + 3)) * (after - w)
        w = after
    return w


def fit_posterior(docs: DataFrame, domains: DataFrame, classes: int, sample: int = 6000, most_terms: int = 300) -> Posterior:
    """Fit on at most ``sample`` labelled documents, by a hash of their ids."""
    bounded_batches(docs)
    chosen = domains.orderBy(F.xxhash64("doc_id", F.lit(19)), "doc_id").limit(sample)
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(chosen.withColumnRenamed("domain", "class")), "doc_id"))  # at most ``sample`` ids
    rows = materialize(one_text_per_document(rows, "doc_id", "class"), "mixing-sample")
    per_class = telling_terms(rows, classes, list(range(classes)), most_terms)
    terms = sorted(set().union(*per_class))
    blank = Posterior(terms, np.ones(WIDTH + len(terms) + 1), np.zeros((WIDTH + len(terms) + 1, classes)))

    @F.arrow_udf("array<float>")
    def extract(batch: pa.Array) -> pa.Array:
        return pa.array([blank.features(t.as_py()) for t in batch], pa.list_(pa.float32()))

    got = rows.select("doc_id", "class", extract("text").alias("x")).toPandas().sort_values("doc_id")
    y = got["class"].to_numpy(dtype=np.int64)
    share = np.bincount(y, minlength=classes) / len(y) if len(y) else np.full(classes, 1 / classes)
    if not len(y) or (share > 0).sum() < 2:
        blank.weights[-1] = np.log(np.maximum(share, 1e-30))
        return blank
    x = np.stack(got["x"].to_numpy())
    scale = np.append(x[:, :-1].std(axis=0) + 0.05, 1.0)
    weights = fit_softmax(x / scale, y, classes)
    weights[:, share == 0] = 0
    weights[-1, share == 0] = -1e4
    return Posterior(terms, scale, weights)


def membership(text: Column, model: Posterior, classes: int, tokenizer: str = TOKENIZER, rule: str = RULE) -> Column:
    """struct<n_tokens long, p0 double, p1 double, ...>: a text's tokens by
    ``tokenizer`` (without special tokens) and its domain posteriors.  Without a
    ``tokenizer`` nothing is counted, and n_tokens is null."""
    fields = [("n_tokens", pa.int64())] + [(f"p{k}", pa.float64()) for k in range(classes)]

    @F.arrow_udf("struct<n_tokens:long," + ",".join(f"p{k}:double" for k in range(classes)) + ">")
    def posterior(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tessera.llm.pretokens import text_slices, worker_encoder
        measure = lambda texts: ([None] * len(texts), [None] * len(texts))
        if tokenizer:
            # One split of the texts gives their tokens and, where it can, their terms.
            encoder = worker_encoder(tokenizer, rule, KEPT)
            encoder.watch(tuple(model.terms), model.finder.in_pretoken)
            measure = encoder.measure_column
        for batch in batches:
            n, parts = [], [np.zeros((0, classes))]
            for at, length in text_slices(batch):
                texts = batch[at:at + length]
                sizes, told = measure(texts)
                n += sizes
                rows = []
                for t, seen, words in zip(texts.to_pylist(), told, words_of(texts), strict=True):
                    rows.append(model.features(t, seen, words))
                    if len(rows) == 256:
                        parts.append(model.probabilities(np.stack(rows)))
                        rows = []
                if rows:
                    parts.append(model.probabilities(np.stack(rows)))
            p = np.concatenate(parts)
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64())] + [pa.array(p[:, k].astype(np.float64)) for k in range(classes)],
                fields=[pa.field(*f) for f in fields])

    return posterior(F.coalesce(text, F.lit("")))


def rate_column(steps: list[np.ndarray], p: list[Column]) -> Column:
    """The rate after the given gradient steps, from 1 and never below 0."""
    rate = F.lit(1.0)
    for g in steps:
        move = sum((p[k] * float(g[k]) for k in range(1, len(p))), p[0] * float(g[0]))
        rate = F.greatest(F.lit(0.0), rate - move)
    return rate


def fit_rates(members: DataFrame, targets: list[float], iterations: int = 25, tolerance: float = 1e-9) -> tuple[list[np.ndarray], float]:
    """(steps, gap): gradient steps (short vectors, one per iteration) of the
    rates that match ``targets`` (shares of all tokens), and the largest gap
    that is left, as a share.  Targets that are not met after ``iterations`` of
    them, or that no rates can meet, end with a warning that names the gap.  ``members`` has n_tokens and p0, p1,
    ...; it is read once per iteration."""
    classes = len(targets)
    p, n = [F.col(f"p{k}") for k in range(classes)], F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(classes) for j in range(i, classes)]
    first = members.agg(F.sum(n).alias("n"), *(F.sum(n * p[i] * p[j]).alias(f"m{i}_{j}") for i, j in pairs),
                        *(F.sum(n * p[k]).alias(f"s{k}") for k in range(classes))).first()
    total = first["n"] or 0.0
    if not total:
        return [], 0.0
    present = np.array([first[f"s{k}"] > 1e-9 * total for k in range(classes)])
    wanted = np.where(present, targets, 0.0)
    wanted = total * wanted / max(wanted.sum(), 1e-12)
    moment = np.zeros((classes, classes))
    for i, j in pairs:
        moment[i, j] = moment[j, i] = first[f"m{i}_{j}"]
    inverse = np.linalg.pinv(moment, rcond=1e-9, hermitian=True)
    steps: list[np.ndarray] = []
    now = np.array([first[f"s{k}"] for k in range(classes)])
    for _ in range(iterations):
        residual = np.where(present, now - wanted, 0.0)
        if np.abs(residual).max() <= tolerance * total:
            break
        steps.append(inverse @ residual)
        row = members.select(*p, (n * rate_column(steps, p)).alias("w")).agg(
            *(F.sum(F.col("w") * p[k]).alias(f"s{k}") for k in range(classes))).first()
        now = np.array([row[f"s{k}"] for k in range(classes)])
    gap = float(np.abs(np.where(present, now - wanted, 0.0)).max() / total)
    if gap > MET:
        warnings.warn(f"mixing: targets not met, a domain is {gap:.4f} of all tokens away", stacklevel=2)
    return steps, gap


def copies_column(rate: Column, doc_id: Column) -> Column:
    share = F.pmod(F.xxhash64(doc_id, F.lit(23)), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(rate + share).cast("long")


def mixing_rates(docs: DataFrame, domains: DataFrame, targets: dict[str, float] = TARGETS,
                 tokenizer: str = TOKENIZER, rule: str = RULE) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, copies) of every document."""
    names = list(targets)
    model = fit_posterior(docs, domains, len(names))
    members = materialize(
        docs.select("doc_id", membership(F.col("text"), model, len(names), tokenizer, rule).alias("m")).select("doc_id", "m.*"), "membership")
    steps, _ = fit_rates(members, [targets[k] for k in names])
    p = [F.col(f"p{k}") for k in range(len(names))]
    return (members.withColumn("rate", rate_column(steps, p))
            .select("doc_id", "n_tokens", *(p[k].alias(f"p_{x}") for k, x in enumerate(names)), "rate",
                    copies_column(F.col("rate"), F.col("doc_id")).alias("copies")))


def mix_documents(docs: DataFrame, domains: DataFrame, targets: dict[str, float] = TARGETS,
                  tokenizer: str = TOKENIZER, rule: str = RULE) -> DataFrame:
    """The documents with each row as often as its copies say (0: dropped)."""
    names = list(targets)
    model = fit_posterior(docs, domains, len(names))
    # Tokens and posteriors are written once, for the iterations; the second
    # pass over the texts needs the posteriors alone, which it finds again: that
    # saves a join on all texts.
    counted = membership(F.col("text"), model, len(names), tokenizer, rule)
    members = materialize(docs.select(counted.alias("m")).select("m.*"), "membership")
    steps, _ = fit_rates(members, [targets[k] for k in names])
    inner = "_mixing"
    while inner in docs.columns:
        inner += "_"
    p = [F.col(f"{inner}.p{k}") for k in range(len(names))]
    copies = copies_column(rate_column(steps, p), F.col("doc_id"))
    return (docs.withColumn(inner, membership(F.col("text"), model, len(names), tokenizer=""))
            .withColumn(inner, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
            .select(*(docs[c] for c in docs.columns)))
