"""Language identification by a bidirectional gated recurrent network over
bytes (operator 8).

One gated recurrent unit reads a window of bytes forwards, another backwards;
at every position the two states together give a distribution over languages,
and a document's distribution is the mean over all its positions.  A text is
read whole, in windows of ``WINDOW`` bytes at whose ends the states start anew,
which bounds memory and lets numpy step through many windows at once.  Training
is backpropagation through time with Adam on the driver, over windows sampled
from at most ``per_language`` documents of each language; every position
carries the document's language as its label.

Defined results: a null text, or one without a letter, is ``und`` with score 0
(so are all texts if no language can be learned); every input row gives one
row, repeated ids included; documents with a null language or id teach nothing;
equal probabilities go to the first language by name; an empty table gives an
empty result.  Only doc_id, text and lang are read; lang for training only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import bounded_batches, fold, held_out, one_text_per_document

WINDOW = 96
PAD = 256               # a 257th symbol, whose gate keeps the state as it is
WINDOWS_AT_ONCE = 2048


def initial(hidden: int, languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Parameters: for each direction an input table (gates z, r and candidate
    stacked) and a recurrent matrix; one output layer."""
    make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape).astype(np.float32)
    p = {"out": make(languages, 2 * hidden), "bias": np.zeros((languages, 1), dtype=np.float32)}
    for way in ("f", "b"):
        p["in_" + way] = rng.normal(0, 0.5, (3 * hidden, 257)).astype(np.float32)
        p["rec_" + way] = make(3 * hidden, hidden)
        p["rec0_" + way] = np.zeros((hidden, 1), dtype=np.float32)
    return p


def run_unit(table: np.ndarray, rec: np.ndarray, shift: np.ndarray, symbols: np.ndarray, keep: bool = False):
    """States (T, H, B) of one direction over symbols (T, B); with ``keep``
    also what backpropagation needs."""
    steps, batch = symbols.shape
    hidden = rec.shape[1]
    table = table.copy()
    table[:hidden, PAD] = 60.0
    states = np.empty((steps, hidden, batch), dtype=np.float32)
    h = np.zeros((hidden, batch), dtype=np.float32)
    kept = []
    for t in range(steps):
        x = table.take(symbols[t], axis=1)
        u = rec @ h
        gates = x[:2 * hidden]
        gates += u[:2 * hidden]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:hidden], gates[hidden:]
        inner = u[2 * hidden:]
        inner += shift
        n = r * inner
        n += x[2 * hidden:]
        np.tanh(n, out=n)
        before = h
        h = before - n
        h *= z
        h += n
        states[t] = h
        if keep:
            kept.append((z, r, n, inner, before))
    return (states, kept) if keep else states


def back_unit(table: np.ndarray, rec: np.ndarray, symbols: np.ndarray, kept: list, d_states: np.ndarray):
    """Gradients (table, rec, shift) of one direction by backpropagation
    through time."""
    hidden = rec.shape[1]
    d_table, d_rec, d_shift = np.zeros_like(table), np.zeros_like(rec), np.zeros((hidden, 1), dtype=np.float32)
    d_h = np.zeros_like(d_states[0])
    for t in range(len(symbols) - 1, -1, -1):
        z, r, n, inner, before = kept[t]
        d_h = d_h + d_states[t]
        d_z = d_h * (before - n) * z * (1 - z)
        d_n = d_h * (1 - z) * (1 - n * n)
        d_r = d_n * inner * r * (1 - r)
        d_inner = d_n * r
        d_u = np.concatenate([d_z, d_r, d_inner])
        d_x = np.concatenate([d_z, d_r, d_n])
        np.add.at(d_table.T, symbols[t], d_x.T)
        d_rec += d_u @ before.T
        d_shift += d_inner.sum(axis=1, keepdims=True)
        d_h = d_h * z + rec.T @ d_u
    d_table[:hidden, PAD] = 0
    return d_table, d_rec, d_shift


def reverse(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions for reading each column's first ``length`` symbols backwards;
    padding stays where it is."""
    t = np.arange(len(symbols))[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


def position_probabilities(p: dict, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(T, languages, B): the distribution at every position."""
    order = reverse(symbols, lengths)
    forward = run_unit(p["in_f"], p["rec_f"], p["rec0_f"], symbols)
    backward = run_unit(p["in_b"], p["rec_b"], p["rec0_b"], np.take_along_axis(symbols, order, axis=0))
    hidden = forward.shape[1]
    of_backward = p["out"][:, hidden:] @ backward
    if (lengths == len(symbols)).all():
        logits = of_backward[::-1]
    else:
        logits = np.take_along_axis(of_backward, order[:, None, :], axis=0)
    logits = logits + p["out"][:, :hidden] @ forward
    logits += p["bias"]
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def loss_and_gradients(p: dict, symbols: np.ndarray, lengths: np.ndarray, label: np.ndarray):
    """Mean cross-entropy over all positions, and its gradients."""
    order = reverse(symbols, lengths)
    flipped = np.take_along_axis(symbols, order, axis=0)
    forward, kept_f = run_unit(p["in_f"], p["rec_f"], p["rec0_f"], symbols, keep=True)
    backward, kept_b = run_unit(p["in_b"], p["rec_b"], p["rec0_b"], flipped, keep=True)
    aligned = np.take_along_axis(backward, order[:, None, :], axis=0)
    both = np.concatenate([forward, aligned], axis=1)
    logits = p["out"] @ both + p["bias"]
    logits -= logits.max(axis=1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=1, keepdims=True)
    mask = (np.arange(len(symbols))[:, None] < lengths).astype(np.float32)
    weight = mask / mask.sum()
    columns = np.arange(symbols.shape[1])
    loss = float(-(np.log(prob[:, label, columns] + 1e-12) * weight).sum())
    d_logits = prob
    d_logits[:, label, columns] -= 1
    d_logits *= weight[:, None, :]
    g = {"out": np.einsum("tlb,thb->lh", d_logits, both), "bias": d_logits.sum(axis=(0, 2))[:, None]}
    d_both = p["out"].T @ d_logits
    hidden = forward.shape[1]
    g["in_f"], g["rec_f"], g["rec0_f"] = back_unit(p["in_f"], p["rec_f"], symbols, kept_f, d_both[:, :hidden])
    g["in_b"], g["rec_b"], g["rec0_b"] = back_unit(
        p["in_b"], p["rec_b"], flipped, kept_b, np.take_along_axis(d_both[:, hidden:], order[:, None, :], axis=0))
    return loss, g


def windows_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (WINDOW, n) and lengths (n) of a byte sequence."""
    n = -(-len(raw) // WINDOW)
    symbols = np.full(n * WINDOW, PAD, dtype=np.int64)
    symbols[:len(raw)] = raw
    lengths = np.full(n, WINDOW)
    lengths[-1:] = len(raw) - (n - 1) * WINDOW
    return np.ascontiguousarray(symbols.reshape(n, WINDOW).T), lengths


@dataclass
class LanguageModel:
    languages: list[str]
    parameters: dict[str, np.ndarray]

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(documents, languages): mean over all positions of each text."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        per_doc = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), per_doc)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(owner):
            return out
        symbols = np.full((len(owner), WINDOW), PAD, dtype=np.int16)
        lengths = np.full(len(owner), WINDOW, dtype=np.int64)
        last = np.cumsum(per_doc) - 1
        row = 0
        for t, n, k in zip(texts, sizes, per_doc, strict=True):
            if n:
                symbols[row:row + k].reshape(-1)[:n] = np.frombuffer(t, dtype=np.uint8)
                row += k
        some = sizes > 0
        lengths[last[some]] = sizes[some] - (per_doc[some] - 1) * WINDOW
        # Full windows together, then the partial ones: only these need masks.
        by_length = np.argsort(lengths, kind="stable")[::-1]
        for at in range(0, len(owner), WINDOWS_AT_ONCE):
            rows = by_length[at:at + WINDOWS_AT_ONCE]
            size = lengths[rows]
            longest = int(size.max())
            s = np.ascontiguousarray(symbols[rows, :longest].T)
            prob = position_probabilities(self.parameters, s, size)
            if int(size.min()) < longest:
                prob *= (np.arange(longest)[:, None] < size)[:, None, :]
            np.add.at(out, owner[rows], prob.sum(axis=0).T)
        return out / np.maximum(sizes, 1)[:, None]


def train(windows: list[np.ndarray], labels: np.ndarray, languages: list[str], hidden: int = 8, epochs: int = 12,
          batch: int = 64, rate: float = 0.01, seed: int = 3) -> LanguageModel:
    """Fit the network on byte windows (each at most WINDOW long)."""
    rng = np.random.default_rng(seed)
    p = initial(hidden, len(languages), rng)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    lengths = np.array([len(w) for w in windows])
    symbols = np.full((len(windows), WINDOW), PAD, dtype=np.int64)
    for i, w in enumerate(windows):
        symbols[i, :len(w)] = w
    steps, t = epochs * -(-len(windows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            longest = int(lengths[rows].max())
            _, g = loss_and_gradients(p, np.ascontiguousarray(symbols[rows, :longest].T), lengths[rows], labels[rows])
            t += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                step = rate * (1 - 0.9 * t / steps)
                p[k] = (p[k] - step * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return LanguageModel(languages, p)


def fit_language(docs: DataFrame, per_language: int = 300, windows_each: int = 3, **settings) -> LanguageModel:
    """Train on windows of at most ``per_language`` documents of each language
    outside the hidden fold (a hash of the id decides which)."""
    bounded_batches(docs)
    seen = docs.where(F.col("lang").isNotNull() & (fold("doc_id", 5) != 0) & has_letter(F.col("text")))
    counts = {r["lang"]: r["count"] for r in seen.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], {})
    # A share of each language that gives about per_language documents.
    bound = F.create_map(*(F.lit(v) for k in languages for v in (k, int(min(1.0, per_language / counts[k]) * (1 << 30)))))
    taken = seen.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < bound[F.col("lang")])

    @F.arrow_udf("array<binary>")
    def pieces(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for i, t in zip(ids.to_pylist(), texts, strict=True):
            raw = t.as_py().encode()
            starts = np.random.default_rng(i & 0xFFFFFFFF).integers(0, max(1, len(raw) - WINDOW + 1), windows_each)
            out.append([raw[s:s + WINDOW] for s in sorted(set(starts.tolist()))])
        return pa.array(out, pa.list_(pa.binary()))

    taken = one_text_per_document(taken, "doc_id", "lang")
    rows = taken.select("doc_id", "lang", pieces("doc_id", "text").alias("pieces")).toPandas().sort_values(["doc_id", "lang"])
    windows = [np.frombuffer(w, dtype=np.uint8) for own in rows["pieces"] for w in own]
    place = {k: i for i, k in enumerate(languages)}
    labels = np.array([place[k] for k, own in zip(rows["lang"], rows["pieces"], strict=True) for _ in own])
    return train(windows, labels, languages, **settings) if windows else LanguageModel([], {})


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def language_of(text: Column, model: LanguageModel) -> Column:
    """struct<lang_pred string, score double> of a text."""
    languages = model.languages

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = [], []
            for at in range(0, len(batch), 512):
                texts = [t.as_buffer().to_pybytes() for t in batch[at:at + 512]]
                prob = model.document_probabilities(texts)
                best = prob.argmax(axis=1)
                names += [languages[k] for k in best]
                scores += np.minimum(prob[np.arange(len(best)), best], 1.0).tolist()
            yield pa.array([{"lang_pred": a, "score": b} for a, b in zip(names, scores, strict=True)],
                           pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    unknown = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not languages:
        return unknown
    return F.when(has_letter(text), predict(F.coalesce(text, F.lit("")))).otherwise(unknown)


def identify_language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = fit_language(docs)
    return (docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"),
                        language_of(F.col("text"), model).alias("found"))
            .select("doc_id", "held_out", "found.lang_pred", "found.score"))
