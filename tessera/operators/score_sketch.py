"""Mergeable score summaries (O-EV-8): a KLL sketch per variant and label.

A run's scores become one sketch of a few kilobytes per group, which can be
stored and merged with those of later runs; quantiles of all runs together then
need no score again.  A quantile's rank is off by about 2.3 / k ** 0.9 of the
group's rows (with 99 % confidence); ``RANK_ERROR`` is some five times that for
``SKETCH_K``.  Count, smallest and largest score are exact.  The sketches draw
lots, so two runs over the same scores may give different quantiles, each within
the bound.

Defined results: null scores count as rows but are in no sketch; a group with
null scores only has null quantiles; an empty table gives no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_K = 800
RANK_ERROR = 0.025
GROUPS = ("variant", "label")


def score_sketches(long: DataFrame, *run: str, k: int = SKETCH_K) -> DataFrame:
    """[run columns,] variant, label, n, n_scores, sketch: the summary to store."""
    return long.groupBy(*run, *GROUPS).agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scores"),
                                           F.kll_sketch_agg_double(F.col("score").cast("double"), k).alias("sketch"))


def merge_score_sketches(stored: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """variant, label, n, n_scores, sketch over the runs in ``stored``."""
    return stored.groupBy(*GROUPS).agg(F.sum("n").alias("n"), F.sum("n_scores").alias("n_scores"),
                                       F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(merged: DataFrame, **quantiles: float) -> DataFrame:
    """variant, label, n, and a column per named quantile (0 and 1 are the
    smallest and the largest score)."""
    at = lambda q: F.when(F.col("n_scores") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))))
    return merged.select(*GROUPS, "n", *(at(q).alias(name) for name, q in quantiles.items()))


def rank_errors(long: DataFrame, values: DataFrame, column: str, q: float) -> DataFrame:
    """variant, label, rank_error: how far ``q`` lies outside the share of
    scores below, and up to, the value in ``column`` (0: none).  Exact, from the
    scores counted per distinct value."""
    keys = [F.coalesce(F.col(g), F.lit("")).alias(f"_{g}") for g in GROUPS] + [F.col(g).isNull().alias(f"_{g}_null") for g in GROUPS]
    join_on = [f"_{g}" for g in GROUPS] + [f"_{g}_null" for g in GROUPS]
    counted = long.filter(F.col("score").isNotNull()).groupBy(*GROUPS, "score").agg(F.count(F.lit(1)).alias("_n"))
    met = counted.select(*keys, "score", "_n").join(values.select(*keys, *GROUPS, F.col(column).alias("_v")), join_on)
    n = F.sum("_n")
    below = F.sum(F.when(F.col("score") < F.col("_v"), F.col("_n")).otherwise(0)) / n
    upto = F.sum(F.when(F.col("score") <= F.col("_v"), F.col("_n")).otherwise(0)) / n
    return met.groupBy(*GROUPS).agg(F.greatest(below - q, q - upto, F.lit(0.0)).alias("rank_error"))
