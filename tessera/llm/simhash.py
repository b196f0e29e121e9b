"""SimHash near-duplicates by tiled exact comparison (operator 9).

Distinct fingerprints are compared exactly, tile against tile, by numpy
exclusive-or and bit counts.  Two fingerprints within the radius differ by at
most that radius in the population count of every segment of their bits, and in
the sum over segments of those differences.  So a tile is the fingerprints that
share all segment counts, and tile pairs whose counts differ by more than the
radius in sum are skipped: a fingerprint goes to its own tile and, as a visitor,
to those of the near tiles that come after it.  A tile of more than
``tile_rows`` fingerprints is cut into slices, and its visitors are read in
batches, so a task's memory does not grow with the data.  Rows with the same
fingerprint are linked before all this, by one aggregate.

A task keeps only as many links as its components need, and the components of
all tasks' links are found by Spark.

Defined results: null and empty texts, and texts without a word, have
fingerprint zero and link like any other; repeated ids each keep their row, and
different texts of one id are different nodes; a row with a null id gets its
fingerprint, links with nothing and has a null component; an empty table gives an empty result.  Only doc_id and text are
read; ``keep_first`` passes all other columns through, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import bounded_batches, materialize
from tessera.llm.components import Links, connected

BITS = 64


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest
    found = text.encode().lower().split()        # on bytes: ASCII letters, ASCII white space
    if not found:
        return 0
    if len(found) < words:
        shingles = iter([b" ".join(found)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(itertools.islice(found, k, None) for k in range(words)), strict=False))
        n = len(found) - words + 1
    hashes = map(xxh64_intdigest, shingles, itertools.repeat(seed))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        h = np.fromiter(itertools.islice(hashes, 1 << 14), dtype=np.uint64, count=min(1 << 14, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, words: int = 3, seed: int = 42) -> Column:
    @F.arrow_udf("long")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t.as_py(), words, seed) for t in batch], pa.int64())

    return fingerprints(F.coalesce(text, F.lit("")))


def steps_within(segments: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of segment counts up to ``radius`` in sum of magnitudes:
    the zero step and, of each pair of opposite steps, the later one."""
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=segments)
             if sum(map(abs, s)) <= radius and s >= (0,) * segments]
    return sorted(steps)


def tile_columns(name: str, segments: int) -> list[Column]:
    """Population count of each segment of a fingerprint."""
    width = BITS // segments
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned(F.col(name), width * k).bitwiseAND(F.lit(mask))) for k in range(segments)]


def linked_pairs(own: np.ndarray, visitors: np.ndarray, radius: int, side: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most ``radius`` bits apart, one comparison tile at a time."""
    own, visitors = own.view(np.uint64), visitors.view(np.uint64)
    for i in range(0, len(own), side):
        for j in range(0, len(visitors), side):
            near = np.bitwise_count(own[i:i + side, None] ^ visitors[None, j:j + side]) <= radius
            a, b = np.nonzero(near)
            if len(a):
                yield a + i, b + j


def similar_fingerprints(rows: DataFrame, radius: int = 2, segments: int = 4, tile_rows: int = 8192) -> DataFrame:
    """(a, b) links over ``rows`` (node long, fp long; distinct fingerprints)
    that give the components of all pairs at most ``radius`` bits apart."""
    base = BITS // segments + 1
    tile = sum((c.cast("long") * base ** k for k, c in enumerate(tile_columns("fp", segments))), F.lit(0).cast("long"))
    counted = rows.select("node", "fp", tile.alias("home"), *(
        c.alias(f"c{k}") for k, c in enumerate(tile_columns("fp", segments))))
    # At most (64 / segments + 1) ** segments rows, whatever the input.
    slices = (counted.groupBy("home").count().where(F.col("count") > tile_rows)
              .select(F.col("home").alias("tile"), F.ceil(F.col("count") / tile_rows).cast("int").alias("slices")))
    visits = F.array(*(
        F.when(F.greatest(*(F.col(f"c{k}") + d for k, d in enumerate(s)), F.lit(0)).between(0, base - 1)
               & (F.least(*(F.col(f"c{k}") + d for k, d in enumerate(s)), F.lit(0)) >= 0),
               F.col("home") + sum(d * base ** k for k, d in enumerate(s)))
        for s in steps_within(segments, radius)))
    visitors = (counted.select("node", "fp", F.explode(F.array_compact(visits)).alias("tile"))
                .join(F.broadcast(slices), "tile", "left")
                .select("tile", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice"),
                        F.lit(1).alias("role"), "node", "fp"))
    own = (counted.join(F.broadcast(slices), F.col("home") == F.col("tile"), "left")
           .select(F.col("home").alias("tile"),
                   F.pmod(F.xxhash64("fp"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"),
                   F.lit(0).alias("role"), "node", "fp"))

    def compare(batches: Iterator) -> Iterator:
        links = Links()
        here, nodes, prints = None, [], []
        mine = mine_fp = np.zeros(0, dtype=np.int64)
        for batch in batches:
            tile_id, slice_id, role, node, fp = (batch.column(k).to_numpy() for k in range(5))
            key = tile_id * (1 << 20) + slice_id
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(role) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(key)], strict=True):
                if lo == hi:
                    continue
                if key[lo] != here:
                    here, nodes, prints = key[lo], [], []
                    mine = mine_fp = np.zeros(0, dtype=np.int64)
                if role[lo] == 0:
                    nodes.append(node[lo:hi])
                    prints.append(fp[lo:hi])
                    continue
                if nodes:
                    mine, mine_fp = np.concatenate(nodes + [mine]), np.concatenate(prints + [mine_fp])
                    nodes, prints = [], []
                for a, b in linked_pairs(mine_fp, fp[lo:hi], radius):
                    links.add(mine[a], node[lo:hi][b])
        a, b = links.pack()
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = own.unionByName(visitors).repartition("tile", "slice").sortWithinPartitions("tile", "slice", "role")
    return dealt.mapInArrow(compare, "a long, b long")


def fingerprints_of(docs: DataFrame, words: int, seed: int) -> DataFrame:
    bounded_batches(docs)
    return materialize(
        docs.select(F.col("doc_id").cast("long"), fingerprint_column(F.col("text"), words, seed).alias("fp")), "fingerprints")


def groups_of(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, least, group): each fingerprint of ``prints``, its smallest doc_id,
    and the smallest fingerprint of its component."""
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = connected(similar_fingerprints(first.select(F.col("fp").alias("node"), "fp"), radius)).withColumnRenamed("node", "fp")
    return first.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, component_id) of every document."""
    prints = fingerprints_of(docs, words, seed)
    groups = groups_of(prints.where("doc_id is not null"), radius)
    component = groups.join(groups.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "component_id")
    # A frequent fingerprint's rows are on the left side only, which adaptive
    # execution splits.
    return (prints.join(component, "fp", "left")
            .select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row of each component: of its smallest doc_id, and of that id's
    texts in it, the one of the smallest fingerprint.  An id with texts in
    several components may stay once in each.  Rows with a null id have
    components of their own, and one row of each stays.

    The texts are joined with the rows to keep by sort-merge at every size:
    they are shuffled once, and no estimate turns it into a broadcast."""
    prints = fingerprints_of(docs, words, seed)
    named = prints.where("doc_id is not null")
    # Of a component's rows, the smallest id is that of the smallest (least, fp).
    first = (groups_of(named, radius).groupBy("group").agg(F.min(F.struct("least", "fp")).alias("m"))
             .select(F.col("m.least").alias("doc_id"), "m.fp"))
    times = named.groupBy("doc_id").agg((F.count("*") > 1).alias("several"))
    first = materialize(first.join(times, "doc_id"), "kept-rows")
    kept = docs.join(first.where("not several").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    fp = "_fp"
    while fp in docs.columns:
        fp += "_"
    # Only rows whose id does not name them need their fingerprint again.
    several = first.where("several").select("doc_id", F.col("fp").alias(fp))
    if several.take(1):
        rows = docs.join(several.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select(*docs.columns)
        rows = rows.withColumn(fp, fingerprint_column(F.col("text"), words, seed)).join(several.hint("merge"), ["doc_id", fp], "left_semi")
        kept = kept.unionByName(rows.dropDuplicates(["doc_id", fp]).select(*docs.columns))
    nameless = prints.where("doc_id is null")
    if nameless.take(1):
        lone = groups_of(nameless, radius).groupBy("group").agg(F.min("fp").alias(fp)).select(fp)
        rows = docs.where("doc_id is null").withColumn(fp, fingerprint_column(F.col("text"), words, seed)).join(lone.hint("merge"), fp, "left_semi")
        kept = kept.unionByName(rows.dropDuplicates([fp]).select(*docs.columns))
    return kept
