"""Schema jobs: parse each distinct schema once, prune per example, reformat.

One database schema serves many questions, so the parse runs once per distinct
schema text (a partial+final aggregate, so a hot schema collapses map-side) and
the catalog is joined back on the text's md5, 16 bytes wide.  The join is by
shuffle unless adaptive execution measures the catalog to be under the broadcast
threshold; a hot schema's rows are split by its skew handling.

``mode="documented"`` (the default) follows what the format promises, foreign
keys included; ``mode="observed"`` reproduces the original code's results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.schema_text import (
    parse_schema, parse_schema_documented, prune_plan, prune_planned, question_tokens, reformat_schema,
    reformat_schema_documented,
)


MODES = ("observed", "documented")
MODE = "documented"


def _parser(mode: str):
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return parse_schema_documented if mode == "documented" else parse_schema


def parsed_catalog(df: DataFrame, schema_col: str = "db_schema", mode: str = MODE) -> DataFrame:
    """schema_id, <schema_col>, tables -- one row per distinct schema text (O-SCH-1)."""
    d = df.select(F.coalesce(F.col(schema_col), F.lit("")).alias(schema_col)).distinct()
    return d.select(F.md5(F.col(schema_col)).alias("schema_id"), schema_col,
                    _parser(mode)(F.col(schema_col)).alias("tables"))


def _tables_exploded(catalog: DataFrame) -> DataFrame:
    """schema_id, table_pos, t -- one row per parsed table.

    ``posexplode_outer`` plus an explicit null filter: for a plain
    ``posexplode`` Catalyst infers ``size(tables) > 0`` and, ``tables`` being a
    function of the distinct key, pushes that filter below the distinct --
    which would parse the schema text of every input row instead of every
    distinct schema.
    """
    e = catalog.select("schema_id", F.posexplode_outer("tables").alias("table_pos", "t"))
    return e.filter(F.col("t").isNotNull())


def catalog_tables(catalog: DataFrame) -> DataFrame:
    """schema_table rows: schema_id, table_pos, table_key, table_name, pks, n_columns."""
    return _tables_exploded(catalog).select(
        "schema_id", "table_pos", F.col("t.key").alias("table_key"), F.col("t.name").alias("table_name"),
        F.col("t.pks").alias("pks"), F.size("t.columns").alias("n_columns"))


def catalog_columns(catalog: DataFrame) -> DataFrame:
    """schema_column rows: schema_id, table_key, col_pos, col_name, col_type."""
    t = _tables_exploded(catalog)
    c = t.select("schema_id", F.col("t.key").alias("table_key"), F.posexplode_outer("t.columns").alias("col_pos", "c"))
    return c.filter(F.col("c").isNotNull()).select(
        "schema_id", "table_key", "col_pos", F.col("c.name").alias("col_name"), F.col("c.type").alias("col_type"))


def _per_schema(df: DataFrame, schema_col: str, value, name: str) -> DataFrame:
    """``df`` with ``name`` = ``value`` of its schema text, computed once per
    distinct text and joined back on the text's md5."""
    text = F.coalesce(F.col(schema_col), F.lit(""))
    # The merge hint keeps the static size estimate, taken before anything is
    # parsed, from choosing a broadcast.
    catalog = df.select(text.alias("_text")).distinct().select(F.md5("_text").alias("_schema_key"),
                                                               value(F.col("_text")).alias(name))
    return df.withColumn("_schema_key", F.md5(text)).join(catalog.hint("merge"), "_schema_key", "left").drop("_schema_key")


def with_parsed(df: DataFrame, schema_col: str = "db_schema", mode: str = MODE) -> DataFrame:
    """Attach ``tables`` (parsed once per distinct schema) to every row."""
    return _per_schema(df, schema_col, _parser(mode), "tables")


def prune_schemas(df: DataFrame, min_tables: int, max_cols: int, out: str = "pruned_schema",
                  schema_col: str = "db_schema", question_col: str = "question", mode: str = MODE) -> DataFrame:
    """Add ``out``: the schema pruned to the tables/columns the question needs (O-SCH-9).

    ``mode="observed"`` reproduces the original rules exactly (no foreign keys
    are ever recognised, extra closing parens in the output);
    ``mode="documented"`` parses all four notations with foreign keys, follows
    FK links, ranks by FK degree and renders valid compressed text.  At most
    ``max_cols`` columns of a table are kept: that is the operator's meaning.
    """
    parse = _parser(mode)
    p = _per_schema(df, schema_col, lambda text: prune_plan(parse(text)), "_plan").withColumn("_tokens", question_tokens(F.col(question_col)))
    return p.withColumn(out, prune_planned(F.col("_plan"), F.col("_tokens"), F.col(schema_col), min_tables, max_cols,
                                           documented=(mode == "documented"))).drop("_plan", "_tokens")


def prune_dataset_report(pruned: DataFrame, out: str = "pruned_schema", schema_col: str = "db_schema") -> DataFrame:
    """Changed / total / percent over a pruned dataset (O-SCH-10)."""
    return pruned.agg(F.count(F.lit(1)).alias("n_total"),
                      F.count_if(F.col(out) != F.col(schema_col)).alias("n_pruned")).select(
        "n_total", "n_pruned",
        F.round(F.try_divide(F.col("n_pruned") * 100.0, F.col("n_total")).cast("double"), 6).alias("pct_pruned"))


def reformat_schemas(df: DataFrame, schema_col: str = "db_schema", out: str = "formatted_schema",
                     mode: str = MODE) -> DataFrame:
    """Add the clear multi-line rendering of each row's schema (O-SCH-11), computed per distinct schema."""
    return _per_schema(df, schema_col, reformat_schema_documented if mode == "documented" else reformat_schema, out)


def schema_cards(catalog: DataFrame, max_columns: int = fixed.MAX_CARD_COLUMNS, description: str = "") -> DataFrame:
    """Cards of every table (O-SCH-12): the table line plus column lines.

    A table of more than ``max_columns`` columns gets further cards, numbered
    by ``card_page`` from 0; each column is on one of them.  Table card
    ``Table {name}: {description}`` + ``Columns: a, b, ...``; column card
    ``  - {column} ({type}): {description}``.  No description source exists, so
    it is a parameter (empty by default).
    """
    t = _tables_exploded(catalog)
    last = F.greatest(F.ceil(F.size("t.columns") / max_columns).cast("int") - 1, F.lit(0))
    t = t.select("schema_id", "table_pos", "t", F.explode(F.sequence(F.lit(0), last)).alias("card_page"))
    cols = F.slice(F.col("t.columns"), F.col("card_page") * max_columns + 1, F.lit(max_columns))
    table_line = F.concat(F.lit("Table "), F.col("t.name"), F.lit(": " + description + "\nColumns: "),
                          F.array_join(F.transform(cols, lambda c: c["name"]), ", "))
    col_lines = F.transform(cols, lambda c: F.concat(F.lit("  - "), c["name"], F.lit(" ("), c["type"],
                                                     F.lit("): " + description)))
    card = F.concat_ws("\n", table_line, F.array_join(col_lines, "\n"))
    return t.select("schema_id", "table_pos", "card_page", F.col("t.name").alias("table_name"), card.alias("card"))


def assemble_context(cards: DataFrame, budget: int = fixed.MAX_CONTEXT_TOKENS) -> DataFrame:
    """Contexts of a schema's cards, in order, by token budget (O-WN-2 / O-RT-2).

    The running token count decides a card's context page: page 0 holds the
    cards whose running count stays within ``budget``, page 1 those within
    twice of it, and so on, so every card is in a context (a later page may
    exceed the budget by the card that crosses over).  Tokens are white-space
    separated words.  The window and the final concatenation are keyed by
    schema: a task holds the cards of one schema text, which one row held.
    """
    from pyspark.sql import Window
    order = ["table_pos", "card_page"]
    w = Window.partitionBy("schema_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n_tok = F.size(F.split(F.trim(F.col("card")), r"\s+"))
    c = cards.withColumn("n_tokens", n_tok).withColumn("running_tokens", F.sum("n_tokens").over(w))
    page = F.floor((F.col("running_tokens") - 1) / budget).cast("int")
    return c.withColumn("context_page", page).groupBy("schema_id", "context_page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "card"))), lambda x: x["card"]), "\n\n")
        .alias("context"), F.count(F.lit(1)).alias("n_cards"), F.sum("n_tokens").alias("n_tokens"))


def attach_context(df: DataFrame, contexts: DataFrame, schema_col: str = "db_schema") -> DataFrame:
    """Every row of ``df`` with each of its schema's context pages; a row whose
    schema has no card gets page 0 without text."""
    keyed = df.withColumn("schema_id", F.md5(F.coalesce(F.col(schema_col), F.lit(""))))
    j = keyed.join(contexts.hint("merge"), "schema_id", "left")
    return j.withColumns({"context_page": F.coalesce("context_page", F.lit(0)), "context": F.coalesce("context", F.lit("")),
                          "n_cards": F.coalesce("n_cards", F.lit(0).cast("long")),
                          "n_tokens": F.coalesce("n_tokens", F.lit(0).cast("long"))})
