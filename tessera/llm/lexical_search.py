"""Ranked lexical search with hashed max-sketches (operator 12).

The index holds a row per document: its distinct terms with their frequencies,
and a sketch of fixed width into which the terms are hashed, each coordinate
keeping the largest of what falls into it.  A term's impact in a document grows
with its frequency and depends otherwise on the document's length alone, so the
sketch keeps frequencies: put through the impact formula, coordinatewise maxima
of frequencies are the coordinatewise maxima of impacts.  Corpus totals come in
at search time only, and an index stays valid when documents are added to it.

A search scans the index once per block of items.  One matrix product of a
batch of sketches with the block's hashed weights gives an upper bound of the
score of every document for every item.  For each item, documents are rescored
exactly in descending order of their bounds, until the next bound is below the
item's k-th best score so far.  A task hands on the k best of each item, and a
window ranks those.  Documents are neither shuffled nor sent to the driver; a
block of items (at most ``BLOCK_ITEMS`` of them, and a new one is begun after
``BLOCK_TERMS`` terms) travels to the tasks.

Defined results: null and empty texts, and texts without a term, match nothing
and count nowhere; an item without a term, or with a null text, has no row; of
equal scores the smaller doc_id comes first, a null one last; repeated rows are
documents or items of their own; empty tables give an empty result.  Only
doc_id, text, item_id and text are read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import materialize

WIDTH = 1024                # coordinates of a sketch
MOST = 65_535               # frequencies from here on count as unbounded in a sketch
BLOCK_ITEMS = 1024
BLOCK_TERMS = 1 << 18
SCANNED = 512               # documents per matrix product
ROUND = 32                  # documents rescored per item before its threshold is looked at again
SALTS = 64

#: Bytes of terms stay (A-Z as a-z), all others become white space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "doc_id long, n long, terms array<binary>, freqs array<int>, sketch binary"


def terms_of(text: str) -> list[bytes]:
    """Terms in order, with repeats, in UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def coordinates(terms: list[bytes], width: int) -> np.ndarray:
    return np.fromiter(map(crc32, terms), dtype=np.int64, count=len(terms)) % width


def fold_frequencies(terms: list[bytes], freqs: np.ndarray, width: int) -> np.ndarray:
    """Largest frequency of each coordinate."""
    sketch = np.zeros(width, dtype=np.int64)
    np.maximum.at(sketch, coordinates(terms, width), freqs)
    return np.minimum(sketch, MOST).astype("<u2")


def impacts(freqs: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return 1_000_000_000 * freqs // (1000 * freqs + 12 * m)


def build_index(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Index rows of the documents that have a term."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SCANNED):
                part = batch.slice(at, SCANNED)
                got = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    terms = terms_of(text.as_py() or "")
                    if terms:
                        counted = Counter(terms)
                        distinct, freqs = list(counted), np.fromiter(counted.values(), dtype=np.int64)
                        got.append((doc_id, len(terms), distinct, freqs, fold_frequencies(distinct, freqs, width).tobytes()))
                if got:
                    ids, n, distinct, freqs, sketches = zip(*got, strict=True)
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(distinct, pa.list_(pa.binary())),
                                           pa.array(freqs, pa.list_(pa.int32())), pa.array(sketches, pa.binary())],
                                          names=["doc_id", "n", "terms", "freqs", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, INDEX)


class Block:
    """Items of a search with the weights of their terms."""

    def __init__(self, items: list[tuple[int, list[tuple[bytes, int]]]], width: int):
        self.names = [i for i, _ in items]
        self.place = {t: at for at, t in enumerate(dict.fromkeys(t for _, terms in items for t, _ in terms))}
        self.terms = [np.array([self.place[t] for t, _ in terms], dtype=np.int64) for _, terms in items]
        self.weights = [np.array([w for _, w in terms], dtype=np.int64) for _, terms in items]
        folded = np.zeros((width, len(items)))
        for at, (_, terms) in enumerate(items):
            np.add.at(folded[:, at], coordinates([t for t, _ in terms], width), self.weights[at])
        self.used = np.flatnonzero(folded.any(axis=1))
        self.folded = folded[self.used]


class Search:
    """The k best documents of each item of a block, over one task's rows."""

    def __init__(self, block: Block, k: int, documents: int, total: int):
        self.block, self.k, self.documents, self.total = block, k, documents, total
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in block.names]
        self.least = np.ones(len(block.names))      # a score that may still enter: at least 1, then the k-th best
        self.row = np.zeros(len(block.place), dtype=np.int64)
        self.scored = 0

    def bounds(self, sketches: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Upper bounds (documents, items); the slack covers rounded sums."""
        freqs = sketches[:, self.block.used].astype(np.int64)
        most = np.where(freqs == MOST, 1_000_000, impacts(freqs, m[:, None]))
        return (most.astype(np.float64) @ self.block.folded) * (1 + 1e-12)

    def add(self, part: pa.RecordBatch) -> None:
        ids, n = part.column(0).to_pylist(), part.column(1).to_pylist()
        m = np.array([75 + 25 * x * self.documents // self.total for x in n], dtype=np.int64)
        sketches = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype="<u2").reshape(len(n), -1)
        bounds = self.bounds(sketches, m)
        waiting = {}
        for item in np.flatnonzero((bounds >= self.least).any(axis=0)):
            order = np.argsort(-bounds[:, item], kind="stable")
            waiting[item] = order[:np.searchsorted(-bounds[order, item], -self.least[item], side="right")]
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        while waiting:
            asked: dict[int, list[int]] = {}
            for item, order in waiting.items():
                for doc in order[:ROUND]:
                    asked.setdefault(int(doc), []).append(item)
            found: dict[int, list[tuple[int, bool, int]]] = {}
            for doc, items in asked.items():
                if doc not in known:
                    known[doc] = self.matching(part, doc, int(m[doc]))
                at, impact = known[doc]
                self.row[at] = impact
                for item in items:
                    score = int(self.row[self.block.terms[item]] @ self.block.weights[item])
                    if score >= self.least[item]:
                        found.setdefault(item, []).append((-score, ids[doc] is None, ids[doc] or 0))
                self.row[at] = 0
                self.scored += len(items)
            for item, new in found.items():
                self.best[item] = heapq.nsmallest(self.k, self.best[item] + new)
                if len(self.best[item]) == self.k:
                    self.least[item] = -self.best[item][-1][0]
            left = {item: order[ROUND:] for item, order in waiting.items()}
            waiting = {item: order for item, order in left.items() if len(order) and bounds[order[0], item] >= self.least[item]}

    def matching(self, part: pa.RecordBatch, doc: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and impacts of a document's terms that the block asks for."""
        place, freqs = self.block.place, part.column(3)[doc].as_py()
        found = [(place[t], f) for t, f in zip(part.column(2)[doc].as_py(), freqs, strict=True) if t in place]
        at, freq = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return at, impacts(freq, m)

    def rows(self) -> pa.RecordBatch:
        got = [(self.block.names[i], None if null else doc, -less) for i, best in enumerate(self.best) for less, null, doc in best]
        item, doc, score = zip(*got, strict=True) if got else ((), (), ())
        return pa.record_batch([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                               names=["item", "doc_id", "score"])


def search_block(index: DataFrame, block: Block, k: int, documents: int, total: int) -> DataFrame:
    """item, doc_id, score: at most ``k`` rows per item of each task."""
    held = index.sparkSession.sparkContext.broadcast(block)     # at most BLOCK_ITEMS columns of WIDTH weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(held.value, k, documents, total)
        for batch in batches:
            for at in range(0, batch.num_rows, SCANNED):
                search.add(batch.slice(at, SCANNED))
        yield search.rows()

    return index.select("doc_id", "n", "terms", "freqs", "sketch").mapInArrow(scan, "item long, doc_id long, score long")


def weighted_items(index: DataFrame, items: DataFrame, documents: int) -> DataFrame:
    """item, terms: each item's distinct terms that occur in the corpus, with
    their weights times their occurrences in the item."""
    asked = items.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1)))
    return (asked.join(df, "term").select("item", "term", (F.col("times") * weight).cast("long").alias("weight"))
            .groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms")))


def blocks_of(weighted: DataFrame, width: int, most_items: int, most_terms: int) -> Iterator[Block]:
    """The items in blocks; the driver holds one partition of them at a time."""
    held: list[tuple[int, list[tuple[bytes, int]]]] = []
    terms = 0
    for row in weighted.toLocalIterator():
        held.append((row["item"], [(bytes(t["term"]), t["weight"]) for t in row["terms"]]))
        terms += len(row["terms"])
        if len(held) >= most_items or terms >= most_terms:
            yield Block(held, width)
            held, terms = [], 0
    if held:
        yield Block(held, width)


def search(docs: DataFrame, items: DataFrame, k: int = 20, width: int = WIDTH, block_items: int = BLOCK_ITEMS,
           block_terms: int = BLOCK_TERMS, index: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of the highest score
    above 0 for each item.  ``index``: a stored index of the documents."""
    if index is None:
        index = materialize(build_index(docs, width), "lexical-index")
    documents, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [terms_of(t or "") for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary()))],
                                  names=["item", "item_id", "terms"])

    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), F.col("text").cast("string"))
    asked = materialize(asked.mapInArrow(tokenised, "item long, item_id long, terms array<binary>"), "items")
    weighted = materialize(weighted_items(index, asked, documents), "item-weights")
    found = asked.select("item", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    for block in blocks_of(weighted, width, block_items, block_terms):
        found = found.unionByName(materialize(search_block(index, block, k, documents, total), "found"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("_salt", F.spark_partition_id() % SALTS)
    first = Window.partitionBy("item", "_salt").orderBy(*order)
    last = Window.partitionBy("item").orderBy(*order)
    kept = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    ranked = kept.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


#: The same by SQL, for unique ids.
ORACLE = r"""
WITH letters AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u,
                        'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, u, l), p)) AS term FROM documents, letters),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, u, l), p)) AS term FROM benchmark, letters),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
tot AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM len),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, tot GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL),
scored AS (
  SELECT item_id, tf.doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nl)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN len ON len.doc_id = tf.doc_id, tot GROUP BY item_id, tf.doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
