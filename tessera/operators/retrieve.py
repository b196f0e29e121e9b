"""Similarity search: query vectors against all rows (O-RT-1).

The queries are a DataFrame of any size.  They are written once and taken in
blocks of at most ``BLOCK_ROWS`` vectors; each block travels to the tasks that
scan the corpus, so corpus rows are never shuffled, whatever the number of
blocks.  A task keeps the k best rows per query, and only those are shuffled.
Half of a row's components and the length of the rest bound its cosines
(Cauchy-Schwarz); a row that no query can use any more is not multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.session import scratch_path

BLOCK_ROWS = 4096       # query vectors in a block: 2 MB per 64 components
BATCH_ROWS = 512        # corpus rows that a block is scored against at once
SALTS = 64
SLACK = 1e-9            # more than a matrix product differs from a sum in order


def _rows(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, vectors, squared lengths) of the vectors of each width.  Squares
    and products are added up in the order of the components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(widths) - widths
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        rows = flat[start[at][:, None] + np.arange(width)]
        yield ids.take(pa.array(at)), rows, in_order(rows, rows)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class Block:
    """Query vectors of one width, with the k best rows of each so far."""

    def __init__(self, ids: pa.Array, rows: np.ndarray, squares: np.ndarray, k: int, threshold: float):
        self.ids, self.rows, self.squares, self.k, self.threshold = ids, rows, squares, k, threshold
        self.unit = rows / np.sqrt(squares)[:, None]
        self.half = rows.shape[1] // 2
        self.rest = np.linalg.norm(self.unit[:, self.half:], axis=1)
        none = np.zeros(0, dtype=np.int64)
        self.query, self.row, self.null, self.cosine = none, none, none.astype(bool), np.zeros(0)

    def add(self, ids: pa.Array, rows: np.ndarray, squares: np.ndarray) -> None:
        full = np.bincount(self.query, minlength=len(self.rows)) == self.k
        worst = np.full(len(self.rows), np.inf)
        np.minimum.at(worst, self.query, self.cosine)
        least = np.full(len(self.rows), self.threshold)
        least[full] = np.maximum(self.threshold, worst)[full]
        unit = rows / np.sqrt(squares)[:, None]
        # Half of the components and the lengths of the other halves bound a
        # cosine; rows that reach no query's least cosine end here.
        first = self.unit[:, :self.half] @ unit[:, :self.half].T
        reach = first + self.rest[:, None] * np.linalg.norm(unit[:, self.half:], axis=1)
        going = np.flatnonzero((reach >= least[:, None] - SLACK).any(axis=0))
        if not len(going):
            return
        ids, rows, squares = ids.take(pa.array(going)), rows[going], squares[going]
        near = first[:, going] + self.unit[:, self.half:] @ unit[going, self.half:].T
        if len(rows) > self.k:
            least = np.maximum(least, np.partition(near, len(rows) - self.k, axis=1)[:, len(rows) - self.k])
        i, j = np.nonzero(near >= least[:, None] - SLACK)
        cosine = np.empty(len(i))
        for lo in range(0, len(i), 100_000):
            a, b = i[lo:lo + 100_000], j[lo:lo + 100_000]
            cosine[lo:lo + 100_000] = in_order(self.rows[a], rows[b]) / np.sqrt(self.squares[a] * squares[b])
        kept = cosine >= self.threshold
        i, j = i[kept], j[kept]
        if not len(i):
            return
        query, cosine = np.concatenate([self.query, i]), np.concatenate([self.cosine, np.minimum(cosine[kept], 1.0)])
        row = np.concatenate([self.row, ids.fill_null(0).to_numpy()[j]])
        null = np.concatenate([self.null, ids.is_null().to_numpy(zero_copy_only=False)[j]])
        order = np.lexsort((row, null, -cosine, query))
        query = query[order]
        first = order[np.arange(len(query)) - np.searchsorted(query, query) < self.k]
        self.query, self.row, self.null, self.cosine = (np.concatenate([own, new])[first] for own, new in (
            (self.query, i), (self.row, row[len(self.row):]), (self.null, null[len(self.null):]),
            (self.cosine, cosine[len(self.cosine):])))

    def best(self) -> pa.RecordBatch:
        return pa.record_batch([self.ids.take(pa.array(self.query)), pa.array(self.row, mask=self.null), pa.array(self.cosine)],
                               names=["query_id", "row", "_s"])


def _usable(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """id, v of the vectors that can match: no null, non-finite or zero ones."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) \
        .filter(fine).filter((squares > 0) & (squares < float("inf")))


def _blocks(asked: DataFrame, block_rows: int) -> Iterator[list]:
    """(place, vector) of the queries in blocks; the driver holds one partition
    and one block of them at a time."""
    held = []
    for row in asked.toLocalIterator():
        held.append((row["place"], row["v"]))
        if len(held) == block_rows:
            yield held
            held = []
    if held:
        yield held


def _search_block(corpus: DataFrame, block: list, k: int, threshold: float) -> DataFrame:
    """place, row, _s: per task at most ``k`` rows for each query of the block."""
    held = corpus.sparkSession.sparkContext.broadcast(block)        # at most block_rows vectors

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, vectors = zip(*held.value, strict=True)
        ready = {rows.shape[1]: Block(ids, rows, squares, k, threshold)
                 for ids, rows, squares in _rows(pa.array(places, pa.int64()), pa.array(vectors, pa.list_(pa.float64())))}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(at, BATCH_ROWS)
                for ids, rows, squares in _rows(some.column(0), some.column(1)):
                    if rows.shape[1] in ready:
                        ready[rows.shape[1]].add(ids, rows, squares)
        for x in ready.values():
            best = x.best()
            yield pa.record_batch(best.columns, names=["place", "row", "_s"])

    return corpus.mapInArrow(score, "place long, row long, _s double")


def cosine_top_k_of(corpus: DataFrame, queries: DataFrame, k: int = fixed.TOP_K, threshold: float = fixed.SIMILARITY_THRESHOLD,
                    row_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, ``row_id``, similarity: for each query the ``k`` rows of
    the highest cosine that is at least ``threshold``; ties go by id.

    Null vectors, vectors with a null or non-finite component, of another length
    or of length zero match nothing; a query itself is a row like any other.
    Every row of ``queries`` is a query of its own, with ``k`` places of its
    own, also where an id is repeated or null; a corpus row with a null id comes
    after those it ties with.
    """
    spark = corpus.sparkSession
    path = scratch_path(spark, "query-vectors")
    _usable(queries, row_id, vector).withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    asked = spark.read.schema("id long, v array<double>, place long").parquet(path)
    rows = _usable(corpus, row_id, vector)
    found = asked.select("place", F.col("place").alias("row"), F.lit(0.0).alias("_s")).filter(F.lit(False))
    for block in _blocks(asked.select("place", "v"), block_rows):
        part = scratch_path(spark, "cosine-top-k")
        _search_block(rows, block, k, threshold).write.parquet(part)
        found = found.unionByName(spark.read.schema("place long, row long, _s double").parquet(part))
    order = [F.col("_s").desc(), F.col("row").asc_nulls_last()]
    # A query has k rows of each scan task: first the best of each salt.
    salted = found.withColumn("_salt", F.spark_partition_id() % SALTS)
    first, last = Window.partitionBy("place", "_salt").orderBy(*order), Window.partitionBy("place").orderBy(*order)
    kept = salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
    ranked = kept.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("place", F.col("id").alias("query_id")), "place").select(
        "query_id", "rank", F.col("row").alias(row_id), F.round("_s", 6).alias("similarity"))
