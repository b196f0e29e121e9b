"""Model-input preparation: prompt rendering, variant expansion, token windows,
label masking, mask audit and per-batch padding -- all array expressions.

Token ids enter as an ``array<int>`` column (no vocabulary ships with the
corpus); everything downstream is length arithmetic on arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.prompts import eval_prompt, train_prompt, variants_array
from tessera.operators.schema_ops import MODE, prune_schemas


def training_examples(examples: DataFrame, prune: tuple[int, int] | None = None, mode: str = MODE) -> DataFrame:
    """input / output / full_text per example, optionally on pruned schemas (O-PR-1)."""
    df = examples
    schema = "db_schema"
    if prune is not None:
        df = prune_schemas(df, prune[0], prune[1], mode=mode)
        schema = "pruned_schema"
    inp = train_prompt(F.col("question"), F.col(schema))
    out = F.coalesce(F.col("SQL"), F.lit(""))
    return df.withColumn("input", inp).withColumn("output", out) \
        .withColumn("full_text", F.concat(F.col("input"), F.col("output")))


def variant_prompts(examples: DataFrame, prune: tuple[int, int] = fixed.PRUNE_EVAL, mode: str = MODE) -> DataFrame:
    """One prompt per (example, variant) (O-PR-2/3).

    ``finetuned_prune`` sees the pruned schema when both schema and question
    are non-empty; ``llama`` gets the answer-only suffix.  The 4x expansion is
    a ``posexplode`` of a literal array (narrow), not a join.
    """
    p = prune_schemas(examples, prune[0], prune[1], mode=mode)
    full = eval_prompt(F.col("question"), F.col("db_schema"))
    use_pruned = ((F.col("variant") == "finetuned_prune") & (F.coalesce(F.length("db_schema"), F.lit(0)) > 0)
                  & (F.coalesce(F.length("question"), F.lit(0)) > 0))
    pruned = eval_prompt(F.col("question"), F.col("pruned_schema"))
    x = p.select("*", F.posexplode(variants_array()).alias("variant_ord", "variant"))
    prompt = (F.when(use_pruned, pruned)
              .when(F.col("variant") == "llama", F.concat(full, F.lit(fixed.LLAMA_SUFFIX)))
              .otherwise(full))
    return x.withColumn("prompt", prompt)


def token_windows(rows: DataFrame, ids: str = "ids", input_len: str = "input_len",
                  max_len: int = fixed.MAX_SEQ_LEN) -> DataFrame:
    """One row per window of ``max_len`` ids of each row, numbered by
    ``window_idx`` from 0, with input_ids, attention_mask and labels (O-PR-4).

    Window 0 is the original's truncated input; the further ones hold the ids
    that it cut off, so every id is in one window.  Labels of the first
    ``input_len`` ids of the row are the ignore index.  A row without ids has
    one empty window.
    """
    last = F.greatest(F.ceil(F.size(ids) / max_len).cast("int") - 1, F.lit(0))
    w = rows.withColumn("window_idx", F.explode(F.sequence(F.lit(0), last)))
    w = w.withColumn("input_ids", F.slice(ids, F.col("window_idx") * max_len + 1, F.lit(max_len)))
    n = F.size("input_ids")
    masked = F.least(F.greatest(F.col(input_len) - F.col("window_idx") * max_len, F.lit(0)), n)
    labels = F.concat(F.array_repeat(F.lit(fixed.IGNORE_INDEX), masked),
                      F.slice("input_ids", masked + 1, F.greatest(n - masked, F.lit(0))))
    return w.withColumns({"attention_mask": F.array_repeat(F.lit(1), n), "labels": labels,
                          "truncated": F.size(ids) > max_len})


def mask_audit(windows: DataFrame) -> DataFrame:
    """Over all windows: rows (window 0 of each), windows, windows whose labels
    are all masked (nothing to learn), rows that one window cannot hold, ids,
    and supervised ids (O-PR-5)."""
    first = F.col("window_idx") == 0
    return windows.agg(
        F.count_if(first).alias("n_rows"), F.count(F.lit(1)).alias("n_windows"),
        F.count_if(F.forall("labels", lambda x: x == fixed.IGNORE_INDEX)).alias("n_fully_masked"),
        F.count_if(first & F.col("truncated")).alias("n_truncated"),
        F.sum(F.size("input_ids")).alias("n_tokens"),
        F.sum(F.size(F.filter("labels", lambda x: x != fixed.IGNORE_INDEX))).alias("n_supervised_tokens"))


def pad_batches(inputs: DataFrame, batch_col: str) -> DataFrame:
    """Pad ids / mask / labels to the batch maximum rounded up to a multiple of 8 (O-PR-6).

    The window is partitioned by the batch key (a handful of rows each), so
    it never gathers more than one batch in a task.
    """
    w = Window.partitionBy(batch_col)
    mult = fixed.PAD_MULTIPLE
    longest = F.max(F.size("input_ids")).over(w)
    padded_len = (F.ceil(longest / mult) * mult).cast("int")
    pad = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("padded_len") - F.size(c)))
    return inputs.withColumn("padded_len", padded_len).select(
        "*", pad("input_ids", fixed.PAD_TOKEN_ID).alias("padded_ids"),
        pad("attention_mask", 0).alias("padded_mask"), pad("labels", fixed.IGNORE_INDEX).alias("padded_labels"))
