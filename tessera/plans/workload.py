"""One runnable query per query class, on the star schema (O-WL-1..13).

The classes are the labels of the curated corpus; here each is a real query
over the driver tables.  Anti joins use ``left_anti`` (Catalyst does not
rewrite LEFT JOIN ... IS NULL into one); NOT IN keeps its null rules in a
shuffled anti join (``rows_not_in``); scalar subqueries run
once as a subquery, not as a join.  Money sums are taken in DECIMAL so they
are exact, then cast to DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

WORKLOAD: dict[str, object] = {}
WORKLOAD_SQL: dict[str, str] = {}


def wl(name: str, duck_sql: str):
    def deco(fn):
        WORKLOAD[name] = fn
        WORKLOAD_SQL[name] = duck_sql
        return fn
    return deco


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def revenue() -> Column:
    return money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))


@wl("wl_anti_join_not_exists",
    "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS "
    "(SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def not_exists(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    o = (table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
         .select(F.col("o_custkey").alias("c_custkey")))
    return c.join(o, "c_custkey", "left_anti")


@wl("wl_anti_join_left_null",
    "SELECT p.p_partkey, p.p_name FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey AND l.l_quantity >= 50 "
    "WHERE l.l_orderkey IS NULL")
def left_null(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    li = (table(spark, sf, "lineitem").filter(F.col("l_quantity") >= 50)
          .select(F.col("l_partkey").alias("p_partkey")))
    return p.join(li, "p_partkey", "left_anti")


@wl("wl_anti_join_not_in",
    "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')")
def not_in(spark, sf):
    li = table(spark, sf, "lineitem").filter((F.col("l_quantity") >= 50) & (F.col("l_returnflag") == "R"))
    return rows_not_in(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey", li.select("l_suppkey"))


def rows_not_in(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Rows whose ``key`` is NOT IN the one column of ``listed``, with SQL's
    null rules: nothing is kept if the list holds a null, and a null key only
    if the list is empty.

    The list is made distinct and anti-joined by shuffle; how many rows and
    nulls it holds are scalar subqueries of the same plan, so no job runs before
    the result is asked for, and a list that changes until then is read anew.
    """
    item = F.col(listed.columns[0])
    n_listed = listed.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_nulls = listed.agg(F.count_if(item.isNull()).alias("n")).scalar()
    keys = listed.select(item.alias(key)).distinct()
    kept = rows.filter((n_nulls == 0) & (F.col(key).isNotNull() | (n_listed == 0)))
    return kept.join(keys.hint("merge"), key, "left_anti")


@wl("wl_4plus_table_join",
    "SELECT c.c_mktsegment, p.p_brand, count(*) AS n_lines, "
    "CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue "
    "FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey "
    "JOIN part p ON l.l_partkey = p.p_partkey GROUP BY c.c_mktsegment, p.p_brand")
def four_plus(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"),
                                             "l_extendedprice", "l_discount")
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    j = li.join(o, "l_orderkey").join(c, "o_custkey").join(p, "p_partkey")
    return j.groupBy("c_mktsegment", "p_brand").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(revenue()).cast("double").alias("revenue"))


@wl("wl_3_table_join",
    "SELECT n.n_name, count(*) AS n_orders, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price "
    "FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey "
    "GROUP BY n.n_name")
def three_table(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    return (o.join(c, "o_custkey").join(n, "c_nationkey").groupBy("n_name")
            .agg(F.count(F.lit(1)).alias("n_orders"), F.sum(money("o_totalprice")).cast("double").alias("total_price")))


@wl("wl_2_table_join_agg",
    "SELECT c.c_mktsegment, count(*) AS n_orders, "
    "round(CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_price "
    "FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment")
def two_table_agg(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    g = o.join(c, "o_custkey").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(money("o_totalprice")).alias("_s"))
    return g.select("c_mktsegment", "n_orders", F.round(F.col("_s").cast("double") / F.col("n_orders"), 6).alias("avg_price"))


@wl("wl_2_table_join",
    "SELECT c.c_custkey, c.c_name, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def two_table(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return c.join(n, "c_nationkey").select("c_custkey", "c_name", "n_name")


@wl("wl_date_filtering",
    "SELECT year(o_orderdate) AS o_year, count(*) AS n_orders FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def date_filtering(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate")
    lo, hi = F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz")
    return (o.filter((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi))
            .groupBy(F.year("o_orderdate").alias("o_year")).agg(F.count(F.lit(1)).alias("n_orders")))


@wl("wl_complex_case",
    "SELECT CASE WHEN c_acctbal >= 5000 THEN 'High' WHEN c_acctbal >= 0 THEN 'Medium' ELSE 'Low' END AS balance_tier, "
    "count(*) AS n_customers FROM customer GROUP BY 1")
def complex_case(spark, sf):
    c = table(spark, sf, "customer").select("c_acctbal")
    tier = (F.when(F.col("c_acctbal") >= 5000, "High").when(F.col("c_acctbal") >= 0, "Medium").otherwise("Low"))
    return c.groupBy(tier.alias("balance_tier")).agg(F.count(F.lit(1)).alias("n_customers"))


@wl("wl_subquery",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def subquery(spark, sf):
    o = table(spark, sf, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {o} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {o})",
                     o=o)


@wl("wl_single_table_agg",
    "SELECT l_returnflag, l_linestatus, count(*) AS n_lines, "
    "CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, "
    "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price "
    "FROM lineitem GROUP BY l_returnflag, l_linestatus")
def single_agg(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(money("l_quantity")).cast("double").alias("sum_qty"),
        F.sum(money("l_extendedprice")).cast("double").alias("sum_base_price"))


@wl("wl_single_table_where", "SELECT p_partkey, p_name FROM part WHERE p_size > 40")
def single_where(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_size").filter(F.col("p_size") > 40).drop("p_size")


@wl("wl_simple_select", "SELECT r_regionkey, r_name FROM region")
def simple_select(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", "r_name")


@wl("wl_set_ops",
    "SELECT 'union' AS op, nk FROM (SELECT c_nationkey AS nk FROM customer UNION SELECT s_nationkey FROM supplier) "
    "UNION ALL SELECT 'intersect', nk FROM (SELECT c_nationkey AS nk FROM customer INTERSECT SELECT s_nationkey FROM supplier) "
    "UNION ALL SELECT 'except', nk FROM (SELECT c_nationkey AS nk FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set_ops(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nk"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nk"))
    return (c.union(s).distinct().select(F.lit("union").alias("op"), "nk")
            .unionAll(c.intersect(s).select(F.lit("intersect").alias("op"), "nk"))
            .unionAll(c.subtract(s).select(F.lit("except").alias("op"), "nk")))
