"""Numeric features of whole texts, for the linear models of this subpackage."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import materialize
from tessera.llm.pretokens import content

BLOCK_BYTES, BLOCK_WORDS = 256, 32
SHORT = 24              # bytes added to every length, so that a few letters show no extreme shares
CLASSES = 7
WIDTH = 256 + 2 * CLASSES + 4


def _byte_classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, sentence mark, other
    sign, beyond ASCII."""
    kinds = np.full(256, 5, dtype=np.int64)
    for k, members in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 13, 32), b".,;:?-'\"()")):
        kinds[list(members)] = k
    kinds[128:] = 6
    return kinds


BYTE_CLASS = _byte_classes()
BLOCK_AT = np.arange(1 << 16) // BLOCK_BYTES * CLASSES      # place of a byte's block in the table of classes


#: Marks bytes that white space beyond the ASCII kind begins with.
WIDE_SPACE = bytes(k in (*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3) for k in range(256))


def words_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray] | None]:
    """For each text of a column without nulls the number of its words, how many
    differ, and whether each but the first is the word before it (1 or 0); None
    for a text that may hold white space beyond the ASCII kind."""
    raw, upto = content(texts)
    wide = np.flatnonzero(np.frombuffer(raw.tobytes().translate(WIDE_SPACE), dtype=bool))
    wide = np.diff(np.searchsorted(wide, upto)).tolist()
    parts = pc.ascii_split_whitespace(texts)
    found = parts.flatten().dictionary_encode()
    of = found.indices.to_numpy()
    ends = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy().astype(np.int64)))
    if (empty := pc.index(found.dictionary, "").as_py()) >= 0:      # beside white space at a text's begin or end
        real = of != empty
        of, ends = of[real], np.append(0, np.cumsum(real))[ends]
    same = (of[1:] == of[:-1]).astype(np.int64)
    numbers, last = np.arange(np.diff(ends).max(initial=0)), np.zeros(len(found.dictionary), dtype=np.int64)
    for a, b, beyond in zip(ends[:-1].tolist(), ends[1:].tolist(), wide, strict=True):
        own = of[a:b]
        last[own] = numbers[:b - a]         # of several places of a word one stays
        yield None if beyond else (b - a, int(np.count_nonzero(last[own] == numbers[:b - a])), same[a:max(a, b - 1)])


def shape(text: str, words: tuple[int, int, np.ndarray] | None = None) -> np.ndarray:
    """Features of a text's form (``words``: as ``words_of`` gives them): byte frequencies (square roots), shares of
    byte classes in the whole text and in the block where each is highest,
    adjacent repeats of a word (whole, and highest in a block), distinct words,
    mean length of a word.  An empty text is all zeros."""
    out = np.zeros(WIDTH, dtype=np.float32)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return out
    raw = raw.astype(np.int64)
    out[:256] = np.sqrt(np.bincount(raw, minlength=256) / (len(raw) + SHORT))
    blocks = max(1, len(raw) // BLOCK_BYTES)
    at = BYTE_CLASS.take(raw)
    at += BLOCK_AT[:len(raw)] if len(raw) <= len(BLOCK_AT) else np.arange(len(raw)) // BLOCK_BYTES * CLASSES
    at[blocks * BLOCK_BYTES:] -= CLASSES              # the last block takes what is left over
    table = np.bincount(at, minlength=blocks * CLASSES).reshape(blocks, CLASSES)
    out[256:256 + CLASSES] = table.sum(axis=0) / (len(raw) + SHORT)
    out[256 + CLASSES:256 + 2 * CLASSES] = (table / (table.sum(axis=1, keepdims=True) + SHORT)).max(axis=0)
    if words is None:
        listed = text.split()
        words = len(listed), len(set(listed)), np.frombuffer(bytes(map(eq, listed, islice(listed, 1, None))), dtype=np.uint8).astype(np.int64)
    n, distinct, repeats = words
    if n > 1:
        starts = np.arange(max(1, (n - 1) // BLOCK_WORDS)) * BLOCK_WORDS
        in_block = np.add.reduceat(repeats, starts) / np.diff(np.append(starts, n - 1))
        out[-4:-2] = repeats.mean(), in_block.max()
    out[-2] = distinct / max(n, 1)
    out[-1] = len(raw) / max(n, 1) / 16
    return out


LETTERS = re.compile(r"[^\W\d_]{2,}").findall
STEMS = range(3, 9)
TIMES = (1, 2, 3)


def marked(term: str, times: int) -> set[str]:
    """A term that occurs ``times`` times, as the terms "at least once", "at
    least twice" (marked *2) and so on."""
    return {f"{term}*{k}" if k > 1 else term for k in TIMES if k <= times}


def terms(text: str) -> set[str]:
    """Lower-cased words of two or more letters, and the stems of 3 to 8
    letters of longer words (marked by a trailing hyphen), each at least once
    and, as terms of their own, at least twice and three times."""
    words = Counter(LETTERS(text.lower()))
    stems: Counter = Counter()
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                stems[w[:k] + "-"] += n
    return {t for all_of in (words, stems) for term, n in all_of.items() for t in (marked(term, n) if n > 1 else (term,))}


def shape_column(text: Column) -> Column:
    @F.arrow_udf("array<float>")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shape(t.as_py()) for t in batch], pa.list_(pa.float32()))

    return extract(F.coalesce(text, F.lit("")))


def telling_terms(sample: DataFrame, classes: int, wanted: list[int], most: int, share: float = 0.01,
                  least: int = 3, z: float = 4.0, lift: float = 3.0) -> list[list[str]]:
    """For each wanted class (0 to ``classes`` - 1), the terms that its texts
    hold significantly more often than the others' (at most ``most`` of them,
    highest first).

    ``sample`` is a bounded set of (text, class) rows; its terms are counted in
    Spark and only the selected ones come to the driver.  A term needs
    ``share`` of the class's texts, ``least`` of them at any rate, and to be
    ``lift`` times as frequent as among the others.
    """
    def tally(batches: Iterator) -> Iterator:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for term in terms(text.as_py()):
                    if (n := found.get(term)) is None:
                        n = found[term] = np.zeros(classes, dtype=np.int64)
                    n[k] += 1
            if len(found) > 200_000:
                yield of(found)
                found = {}
        if found:
            yield of(found)

    def of(found: dict) -> pa.RecordBatch:
        table = np.array(list(found.values()))
        return pa.record_batch([pa.array(list(found))] + [pa.array(table[:, k]) for k in range(classes)],
                               names=["term"] + [f"n{k}" for k in range(classes)])

    sizes = {r["class"]: r["count"] for r in sample.groupBy("class").count().collect()}
    total = sum(sizes.values())
    counts = (sample.select("text", F.col("class").cast("int"))
              .mapInArrow(tally, ", ".join(["term string"] + [f"n{k} long" for k in range(classes)]))
              .groupBy("term").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(classes))))
    if len(wanted) > 1:
        counts = materialize(counts, "term-counts")
    chosen = []
    for k in wanted:
        own, rest = sizes.get(k, 0), total - sizes.get(k, 0)
        if not own or not rest:
            chosen.append([])
            continue
        mine, all_of = F.col(f"n{k}"), sum((F.col(f"n{i}") for i in range(1, classes)), F.col("n0"))
        p = all_of / total
        score = (mine / own - (all_of - mine) / rest) / F.sqrt(p * (1 - p) * (1 / own + 1 / rest) + 1e-12)
        lifted = mine / own >= lift * (all_of - mine + 0.5) / rest
        rows = (counts.where((mine >= max(least, share * own)) & lifted).withColumn("z", score).where(F.col("z") >= z)
                .orderBy(F.col("z").desc(), "term").limit(most).collect())
        chosen.append([r["term"] for r in rows])
    return chosen


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
