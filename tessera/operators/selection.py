"""Selection by rank at any size: exact n-th keys, quotas per class, dense row
numbers.  No step sorts a whole class or table in one task.

* ``in_last``: which rows are the last n in an order.  A bracket around the n-th
  key is narrowed by splitters from a bounded sample, each round counting rows
  between splitters in one aggregate, until the key is a splitter or few rows
  are left.
* ``quota_sample``: per class, the rows of the smallest seeded keys.  Rows are
  counted per class and key prefix; every prefix but the one that crosses the
  quota is in or out as a whole, and only that one's rows are ranked.
* ``with_row_number``: numbers rows in file order from the counts of each split.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITTERS = 127
FEW = 10_000            # keys that the last step of a search may hold
PREFIX = 4              # hexadecimal digits: 65,536 prefixes


def _interval(key: Column, splitters: list) -> Column:
    """2 i below splitter i and above the one before it, 2 i + 1 on it."""
    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(2 * lo)
        mid = (lo + hi) // 2
        return (F.when(key < F.lit(splitters[mid]), between(lo, mid)).when(key == F.lit(splitters[mid]), 2 * mid + 1)
                .otherwise(between(mid + 1, hi)))
    return between(0, len(splitters))


def nth_largest(rows: DataFrame, key: str, n: int, splitters: int = SPLITTERS, few: int = FEW) -> tuple:
    """(value, above): the n-th largest value of ``key`` and how many rows have
    a larger one.  ``rows`` has at least n rows with a non-null ``key``."""
    part, above, k = rows.select(key).filter(F.col(key).isNotNull()), 0, F.col(key)
    left, seed = part.count(), 0
    while left > few:
        sample = part.orderBy(F.xxhash64(k, F.lit(seed), F.monotonically_increasing_id())).limit(16 * splitters).collect()
        found = sorted({r[0] for r in sample})
        marks = [found[i * len(found) // (splitters + 1)] for i in range(1, splitters + 1)] if len(found) > splitters else found
        marks = sorted(set(marks))
        counts = {r["i"]: r["n"] for r in part.groupBy(_interval(k, marks).alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()}
        at = 2 * len(marks)                     # at most 2 * splitters + 1 counts
        while above + counts.get(at, 0) < n:
            above += counts.get(at, 0)
            at -= 1
        if at % 2:
            return marks[at // 2], above
        low, high = (marks[at // 2 - 1] if at else None), (marks[at // 2] if at // 2 < len(marks) else None)
        part = part.filter(F.lit(True) if low is None else k > F.lit(low)).filter(F.lit(True) if high is None else k < F.lit(high))
        left, seed = counts[at], seed + 1
    values = sorted((r[0] for r in part.collect()), reverse=True)          # at most ``few`` keys
    value = values[n - above - 1]
    return value, above + sum(v > value for v in values)


def in_last(rows: DataFrame, order: list[str], n: int, **search) -> Column:
    """Whether a row is among the last ``n`` by ``order`` (ascending, null
    first).  Rows that agree in all columns of ``order`` cannot be told apart:
    an error if the cut falls between them."""
    inside, equal, part = F.lit(False), F.lit(True), rows.select(*order)
    total = part.count()
    if n <= 0 or n >= total:
        return F.lit(n > 0)
    for c in order:
        present = part.filter(F.col(c).isNotNull()).count()
        if n > present:                         # all that are present, and some of those without
            inside, equal = inside | (equal & F.col(c).isNotNull()), equal & F.col(c).isNull()
            part, n = part.filter(F.col(c).isNull()), n - present
        else:
            value, above = nth_largest(part, c, n, **search)
            inside = inside | (equal & F.coalesce(F.col(c) > F.lit(value), F.lit(False)))
            equal = equal & F.coalesce(F.col(c) == F.lit(value), F.lit(False))
            part, n = part.filter(F.col(c) == F.lit(value)), n - above
        if n == part.count():
            return inside | equal
    raise ValueError(f"the cut falls between rows that agree in {order}")


def tail_share(rows: DataFrame, order: list[str], share: float, **search) -> DataFrame:
    """``rows`` with ``split``: the last ``share`` of them (rounded down) are
    dev, the rest train.  Nothing is sorted, joined or shuffled but counts."""
    n = int(rows.count() * share)
    return rows.withColumn("split", F.when(in_last(rows, order, n, **search), "dev").otherwise("train"))


def quota_sample(rows: DataFrame, quota: Column, key: Column, by: str = "query_type", tie: str = "ex_id", prefix: int = PREFIX) -> DataFrame:
    """The ``quota`` rows of each class ``by`` with the smallest ``key`` (a
    string of hexadecimal digits, spread evenly), ties by ``tie``.

    ``quota`` is a column over a class's row count ``n``, e.g. ``F.ceil(n /
    10)``.  Counts per class and prefix are at most 16 ** ``prefix`` rows a
    class; of the rows themselves only those of one prefix per class are ranked.
    A null class is a class of its own.
    """
    keyed = rows.withColumn("_key", key).withColumn("_prefix", F.substring("_key", 1, prefix))
    counts = keyed.groupBy(by, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(by)
    upto = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    cut = (counts.select(by, "_prefix", F.sum("_n").over(whole).alias("n"), F.sum("_n").over(upto).alias("_upto"), "_n")
           .withColumn("_quota", F.least(quota.cast("long"), F.col("n")))
           .filter((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
           .select(F.col(by).alias("_by"), F.col("_prefix").alias("_cut"), (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_left")))
    # One row per class: adaptive execution broadcasts it once it is measured to be small.
    placed = keyed.join(cut, F.col(by).eqNullSafe(F.col("_by")))
    within = placed.filter(F.col("_prefix") < F.col("_cut"))
    edge = placed.filter(F.col("_prefix") == F.col("_cut"))
    ranked = edge.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy("_key", tie))) \
        .filter(F.col("_rank") <= F.col("_left"))
    return within.select(*rows.columns).unionByName(ranked.select(*rows.columns))


def with_row_number(rows: DataFrame, file: Column, split: Column, name: str = "row_number") -> DataFrame:
    """``rows`` of a file scan with dense numbers from 1, by file, split and
    place in it.

    ``file`` and ``split`` name where a row was read.  A scan task numbers its
    rows as they come, so a split's numbers are consecutive; the splits' counts,
    a row of three values per 128 MB of input, are added up on the driver and
    come back as a broadcast.  Rows are read twice and not shuffled.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("_file", file).withColumn("_split", split).withColumn("_id", F.monotonically_increasing_id())
    splits = marked.groupBy("_file", "_split").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    splits.sort(key=lambda r: (r["_file"], r["_split"]))
    before = accumulate((r["n"] for r in splits), initial=0)
    offsets = spark.createDataFrame([(r["_file"], r["_split"], b - r["first"] + 1) for r, b in zip(splits, before, strict=False)],
                                    "_file string, _split long, _offset long")
    return (marked.join(F.broadcast(offsets), ["_file", "_split"]).withColumn(name, F.col("_id") + F.col("_offset"))
            .select(*rows.columns, name))
