"""Ranked schema context (O-RT-2 with O-WN-2): the cards that suit a question
best, as many as a token budget allows.

An inverted index maps (schema, token) to the schema's cards; a token weighs the
more the fewer cards of the whole catalog hold it.  Tokens that nearly every
card holds weigh nothing and have no postings, so no join fans out over them.
Questions meet the index in an equality join on (schema, token): a question's
row meets cards of its own schema only, and a frequent schema's questions are on
the side that adaptive execution splits.  Each distinct pair of a question and a
schema is ranked once.

Weights are whole numbers, so scores do not depend on the order of summands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.schema_text import WORD_RUN, question_tokens
from tessera.session import scratch_path


def card_tokens(card: Column) -> Column:
    """Distinct lower-cased words of a card, names taken apart at underscores,
    without stopwords and single characters."""
    words = F.regexp_extract_all(F.replace(F.lower(card), F.lit("_"), F.lit(" ")), F.lit(WORD_RUN), 0)
    stop = F.array(*[F.lit(w) for w in fixed.STOPWORDS])
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1)))


def placed_cards(cards: DataFrame) -> DataFrame:
    """schema_id, place (1, 2, ... in schema order), card, n_tokens, written
    once: a row per card of each distinct schema."""
    order = Window.partitionBy("schema_id").orderBy("table_pos", "card_page")
    path = scratch_path(cards.sparkSession, "cards")
    cards.select("schema_id", F.row_number().over(order).alias("place"), "table_pos", "card_page", "card",
                 F.size(F.split(F.trim("card"), r"\s+")).alias("n_tokens")).write.parquet(path)
    return cards.sparkSession.read.parquet(path)


def postings(placed: DataFrame) -> DataFrame:
    """schema_id, token, place, weight: weight = floor(1000 ln((2 N + 2) /
    (2 df + 1))) over the N cards of the catalog; no row where it is 0."""
    found = placed.select("schema_id", "place", F.explode(card_tokens(F.col("card"))).alias("token"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * placed.count() + 2) / (2 * F.col("_df") + 1)))
    weights = (found.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
               .select("token", weight.alias("weight")).filter(F.col("weight") > 0))
    return found.join(weights.hint("merge"), "token")


def rank_cards(pairs: DataFrame, placed: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """pair, schema_id, rank, place, score: the ``k`` best cards of each pair
    (``pair``, ``schema_id``, ``question``); cards that share no token with the
    question follow in schema order."""
    asked = pairs.select("pair", "schema_id", F.explode(question_tokens(F.col("question"))).alias("token"))
    scored = (asked.join(postings(placed).hint("merge"), ["schema_id", "token"])
              .groupBy("pair", "schema_id", "place").agg(F.sum("weight").alias("score")))
    # The first k cards are enough to fill up with.
    first = placed.filter(F.col("place") <= k).select("schema_id", "place")
    others = pairs.select("pair", "schema_id").join(first.hint("merge"), "schema_id") \
        .select("pair", "schema_id", "place", F.lit(0).cast("long").alias("score"))
    best = Window.partitionBy("pair").orderBy(F.col("score").desc(), "place")
    every = scored.unionByName(others).groupBy("pair", "schema_id", "place").agg(F.max("score").alias("score"))
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def ranked_context(df: DataFrame, cards: DataFrame, k: int = fixed.TOP_K, budget: int = fixed.MAX_CONTEXT_TOKENS,
                   schema_col: str = "db_schema", question_col: str = "question") -> DataFrame:
    """``df`` with ``n_cards``, ``context_tokens``, ``best_score``, ``cards``
    (table_pos.card_page in rank order) and ``context``.

    Of the ``k`` best cards those are taken, in rank order, up to which the
    running count of tokens stays within ``budget``; the best one is taken in
    any case.  A row whose schema has no card keeps an empty context; a null
    question is an empty one.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    keyed = df.withColumn("_schema", F.md5(text(schema_col))) \
        .withColumn("_pair", F.md5(F.concat_ws("|", "_schema", F.md5(text(question_col)))))
    pairs = keyed.select(F.col("_pair").alias("pair"), F.col("_schema").alias("schema_id"), text(question_col).alias("question")) \
        .dropDuplicates(["pair"])
    placed = placed_cards(cards)
    ranked = rank_cards(pairs, placed, k).join(placed.select("schema_id", "place", "n_tokens").hint("merge"), ["schema_id", "place"])
    running = Window.partitionBy("pair").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    taken = ranked.withColumn("running", F.sum("n_tokens").over(running)).filter((F.col("running") <= budget) | (F.col("rank") == 1))
    shown = taken.join(placed.drop("n_tokens").hint("merge"), ["schema_id", "place"])
    parts = F.array_sort(F.collect_list(F.struct("rank", "table_pos", "card_page", "card")))        # at most k cards
    contexts = shown.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n_cards"), F.sum("n_tokens").alias("context_tokens"), F.max("score").alias("best_score"), parts.alias("_parts"))
    contexts = contexts.select(
        F.col("pair").alias("_pair"), "n_cards", "context_tokens", "best_score",
        F.array_join(F.transform("_parts", lambda x: F.concat_ws(".", x["table_pos"], x["card_page"])), " ").alias("cards"),
        F.array_join(F.transform("_parts", lambda x: x["card"]), "\n\n").alias("context"))
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_cards", "context_tokens", "best_score")}
    return (keyed.join(contexts.hint("merge"), "_pair", "left").drop("_pair", "_schema")
            .withColumns(none | {c: F.coalesce(c, F.lit("")) for c in ("cards", "context")}))
