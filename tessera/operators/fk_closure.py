"""Table selection over catalogs too large for one row (O-JN-5, O-SCH-4/5/6).

``prune_parsed`` holds a schema's tables in one row, which suits schemas of
hundreds of tables.  Here a table is a row and a foreign key is a row, and the
same selection is made by joins:

1. matched: names meet question tokens in an equality join.  A name equal to a
   token, or with such a part, shares the whole word; a token inside a name
   shares the token's first three letters with one of the name's grams, and a
   name inside a token the name's first three (or fewer).  Candidates are then
   verified.  Each distinct token of a schema is looked up once, however many
   questions use it.
2. referenced: what a matched table's keys point to, one hop.
3. referencing: tables that point to a selected one.  The in-row rule passes the
   tables once in schema order, so a table that came in this way brings in only
   tables after it.  That is reachability along edges of rising position, found
   by rounds that join the last round's tables with the edges; each round is
   written to the shared folder, so lineage stays short and a lost executor costs
   one round.
4. added: up to ``min_tables``, by foreign-key degree, then name, both descending.
   A schema's first ``min_tables`` tables by degree are enough for any question.

Defined results: a schema without tables, and a null or empty schema, select
nothing; a null question is an empty one, which matches nothing; a key whose
target is unknown or not in the schema counts towards its table's degree only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.schema_text import question_tokens
from tessera.operators.schema_ops import _tables_exploded
from tessera.session import scratch_path

STEPS = ("matched", "referenced", "referencing", "added")


def table_rows(catalog: DataFrame) -> DataFrame:
    """schema_id, table_pos, table_key: a row per table of each parsed schema."""
    return _tables_exploded(catalog).select("schema_id", "table_pos", F.col("t.key").alias("table_key"))


def edge_rows(catalog: DataFrame) -> DataFrame:
    """schema_id, table_pos, table_key, ref_table: a row per foreign key."""
    e = _tables_exploded(catalog).select("schema_id", "table_pos", F.col("t.key").alias("table_key"),
                                         F.explode_outer("t.fks").alias("f"))
    return e.filter(F.col("f").isNotNull()).select("schema_id", "table_pos", "table_key", F.col("f.ref_table").alias("ref_table"))


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters."""
    found = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) >= n, found).otherwise(F.array().cast("array<string>")))


def _marked(kind: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("gram")))


def matching_tables(tokens: DataFrame, tables: DataFrame) -> DataFrame:
    """schema_id, token, table_key for each distinct (schema_id, token) whose
    token matches the name (O-SCH-4)."""
    t, n = F.col("token"), F.col("table_key")
    none = F.array().cast("array<struct<kind:string,gram:string>>")
    inside = F.concat(_marked("token in name", F.array(F.left(t, F.lit(3)))),
                      _marked("name in token", F.concat(_grams(t, 1), _grams(t, 2), _grams(t, 3))))
    asked = tokens.select("schema_id", "token").distinct().select(
        "schema_id", "token", F.explode(F.concat(_marked("word", F.array(t)), F.when(F.length(t) > 2, inside).otherwise(none))).alias("k"))
    words = F.array_distinct(F.concat(F.array(n), F.filter(F.split(n, "_"), lambda p: F.length(p) > 1)))
    held = tables.select("schema_id", "table_key", F.explode(F.concat(
        _marked("word", words), _marked("token in name", _grams(n, 3)), _marked("name in token", F.array(F.left(n, F.lit(3)))))).alias("k"))
    keyed = lambda df, own: df.select("schema_id", own, "k.kind", "k.gram")
    met = keyed(asked, "token").join(keyed(held, "table_key").hint("merge"), ["schema_id", "kind", "gram"])
    sure = (F.col("kind") == "word") | ((F.col("kind") == "token in name") & (F.instr(n, t) > 0)) \
        | ((F.col("kind") == "name in token") & (F.instr(t, n) > 0))
    return met.filter(sure).select("schema_id", "token", "table_key").distinct()


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _closure(base: DataFrame, edges: DataFrame) -> DataFrame:
    """``base`` (pair, schema_id, table_key, step) and the tables that reach it
    by keys of rising position."""
    hops = edges.select("schema_id", F.col("table_key").alias("source"), F.col("table_pos").alias("source_pos"),
                        F.col("ref_table").alias("table_key")).distinct()
    hops = _stored(hops, "fk-hops")
    every = last = base.withColumn("pos", F.lit(-1))        # of the base any later or earlier table may follow
    while True:
        found = last.join(hops.hint("merge"), ["schema_id", "table_key"]).filter(F.col("pos") < F.col("source_pos")) \
            .select("pair", "schema_id", F.col("source").alias("table_key"), F.lit("referencing").alias("step"),
                    F.col("source_pos").alias("pos")).distinct()
        last = _stored(found.join(every.select("pair", "table_key").hint("merge"), ["pair", "table_key"], "left_anti")
                       .select("pair", "schema_id", "table_key", "step", "pos"), "fk-round")
        if last.isEmpty():
            return every.drop("pos")
        every = every.unionByName(last)


def select_tables(pairs: DataFrame, tables: DataFrame, edges: DataFrame, min_tables: int) -> DataFrame:
    """pair, schema_id, table_key, step (one of ``STEPS``): the tables that each
    pair of a question and a schema needs.

    ``pairs``: pair (unique), schema_id, question; ``tables`` and ``edges`` as
    ``table_rows`` and ``edge_rows`` give them, or stored tables of that form.
    """
    tokens = pairs.select("pair", "schema_id", F.explode(question_tokens(F.col("question"))).alias("token"))
    matched = tokens.join(matching_tables(tokens, tables).hint("merge"), ["schema_id", "token"]) \
        .select("pair", "schema_id", "table_key").distinct()
    matched = _stored(matched, "fk-matched")
    targets = edges.select("schema_id", "table_key", "ref_table").distinct() \
        .join(tables.select("schema_id", F.col("table_key").alias("ref_table")).hint("merge"), ["schema_id", "ref_table"])
    referenced = matched.join(targets.hint("merge"), ["schema_id", "table_key"]) \
        .select("pair", "schema_id", F.col("ref_table").alias("table_key"))
    # The first step that selects a table names it.
    order = lambda df, k: df.withColumn("k", F.lit(k))
    base = order(matched, 0).unionByName(order(referenced, 1)).groupBy("pair", "schema_id", "table_key").agg(F.min("k").alias("k")) \
        .select("pair", "schema_id", "table_key", F.element_at(F.lit(list(STEPS)), F.col("k") + 1).alias("step"))
    closed = _closure(_stored(base, "fk-base"), edges)
    if min_tables < 1:
        return closed

    ends = edges.select("schema_id", "table_key").unionByName(edges.select("schema_id", F.col("ref_table").alias("table_key")))
    degree = ends.groupBy("schema_id", "table_key").agg(F.count(F.lit(1)).alias("degree"))
    by_degree = Window.partitionBy("schema_id").orderBy(F.coalesce("degree", F.lit(0)).desc(), F.col("table_key").desc())
    first = tables.select("schema_id", "table_key").join(degree.hint("merge"), ["schema_id", "table_key"], "left") \
        .withColumn("place", F.row_number().over(by_degree)).filter(F.col("place") <= min_tables) \
        .select("schema_id", "table_key", "place")
    have = closed.groupBy("pair").agg(F.count(F.lit(1)).alias("have"))
    short = pairs.select("pair", "schema_id").join(have.hint("merge"), "pair", "left") \
        .select("pair", "schema_id", (min_tables - F.coalesce("have", F.lit(0))).alias("need")).filter(F.col("need") > 0)
    by_place = Window.partitionBy("pair").orderBy("place")
    added = short.join(first.hint("merge"), "schema_id") \
        .join(closed.select("pair", "table_key").hint("merge"), ["pair", "table_key"], "left_anti") \
        .withColumn("nth", F.row_number().over(by_place)).filter(F.col("nth") <= F.col("need")) \
        .select("pair", "schema_id", "table_key", F.lit("added").alias("step"))
    return closed.unionByName(added)


def question_pairs(df: DataFrame, schema_col: str = "db_schema", question_col: str = "question") -> DataFrame:
    """pair, schema_id, question: the distinct pairs of ``df``."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = df.select(F.md5(text(schema_col)).alias("schema_id"), text(question_col).alias("question")).distinct()
    return d.select(F.md5(F.concat_ws("|", "schema_id", F.md5("question"))).alias("pair"), "schema_id", "question")
