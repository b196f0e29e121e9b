"""Derived inputs built from the driver tables.

The engine's inputs are corpora of (question, SQL, db_schema) examples and
(example, variant, answer) predictions.  The driver ships TPC-H-like tables,
so these are derived from them, one example per ``orders`` row:

* the SQL / question text comes from a literal template bank indexed by
  ``o_orderkey % n`` with placeholders filled from the order row;
* the schema text comes from a literal bank of schema texts (four notations
  plus invalid ones) indexed by ``o_custkey % n``;
* predictions are examples x 4 variants, generated by ``posexplode`` over a
  literal array (a narrow Generate, not a join).

All selection is by pure column expressions (``element_at`` over literal
arrays), so deriving the fixtures never shuffles or broadcasts anything.
The same derivation is emitted as DuckDB SQL by :func:`duck_ctes` for the
oracle check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.prompts import variants_array
from tessera.sources.tables import table

# (intended class, question, SQL) -- placeholders {c} customer key,
# {p} order priority, {y} order year.
EXAMPLE_TEMPLATES: list[tuple[str, str, str]] = [
    ("anti_join_not_exists", "Which customers have never placed an order?",
     "SELECT c.c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey);"),
    ("anti_join_not_exists", "List parts never bought by customer {c}",
     "SELECT p.p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_partkey = p.p_partkey AND o.o_custkey = {c});"),
    ("anti_join_left_null", "Which parts have no lineitems?",
     "SELECT p.p_partkey, p.p_name FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey WHERE l.l_orderkey IS NULL;"),
    ("anti_join_left_null", "Find customers without {p} orders",
     "SELECT c.c_name FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '{p}' WHERE o.o_orderkey IS NULL;"),
    ("anti_join_not_in", "List suppliers that do not supply any lineitem",
     "SELECT s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem);"),
    ("anti_join_not_in", "Which nations have no customers other than customer {c}?",
     "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey <> {c});"),
    ("4plus_table_join", "Show order dates and part names for customer {c}",
     "SELECT c.c_name, o.o_orderdate, p.p_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey WHERE c.c_custkey = {c};"),
    ("4plus_table_join", "List region, nation, customer name and order key of every order",
     "SELECT r.r_name, n.n_name, c.c_name, o.o_orderkey FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON n.n_nationkey = c.c_nationkey JOIN orders o ON c.c_custkey = o.o_custkey;"),
    ("3_table_join", "Which nation is customer {c} from and what did they order?",
     "SELECT n.n_name, o.o_orderkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_custkey = {c};"),
    ("3_table_join", "List suppliers with their nation and region names",
     "SELECT s.s_name, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey;"),
    ("2_table_join_agg", "How many orders do customers of each nation place?",
     "SELECT c.c_nationkey, COUNT(*) AS order_count FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey;"),
    ("2_table_join_agg", "What is the total order price per market segment for {p} orders?",
     "SELECT c.c_mktsegment, SUM(o.o_totalprice) AS total_value FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderpriority = '{p}' GROUP BY c.c_mktsegment;"),
    ("2_table_join", "Show the orders of customer {c} with the customer name",
     "SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_custkey = {c};"),
    ("2_table_join", "List customers and their nation names",
     "SELECT c.c_name, n.n_name FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey;"),
    ("date_filtering", "How many orders were placed in {y}?",
     "SELECT COUNT(*) FROM orders WHERE YEAR(o_orderdate) = {y};"),
    ("date_filtering", "List orders of customer {c} placed in 1995 or 1996",
     "SELECT o_orderkey FROM orders WHERE o_custkey = {c} AND o_orderdate BETWEEN '1995-01-01' AND '1996-12-31';"),
    ("complex_case", "Classify customers by account balance",
     "SELECT c_name, CASE WHEN c_acctbal >= 5000 THEN 'High' WHEN c_acctbal >= 0 THEN 'Medium' ELSE 'Low' END AS balance_tier FROM customer;"),
    ("complex_case", "Flag the {p} orders of customer {c}",
     "SELECT o_orderkey, CASE WHEN o_orderpriority = '{p}' THEN 'match' ELSE 'other' END AS flag FROM orders WHERE o_custkey = {c};"),
    ("subquery", "Which orders cost more than the average order?",
     "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders);"),
    ("subquery", "Which customers have a larger balance than customer {c}?",
     "SELECT c_name FROM customer WHERE c_acctbal > (SELECT c_acctbal FROM customer WHERE c_custkey = {c});"),
    ("single_table_agg", "How many customers are in each market segment?",
     "SELECT c_mktsegment, COUNT(*) FROM customer GROUP BY c_mktsegment;"),
    ("single_table_agg", "What is the largest order total for priority {p}?",
     "SELECT MAX(o_totalprice) FROM orders WHERE o_orderpriority = '{p}';"),
    ("single_table_where", "List the orders of customer {c}",
     "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = {c};"),
    ("single_table_where", "Which parts have a size over 40?",
     "SELECT p_name FROM part WHERE p_size > 40;"),
    ("simple_select", "List all region names",
     "SELECT r_name FROM region;"),
    ("simple_select", "Show every supplier name and account balance",
     "SELECT s_name, s_acctbal FROM supplier;"),
    # traps: substring rules fire on names and numbers
    ("single_table_where", "Show the case ids of customer {c}",
     "SELECT CaseID FROM support_case WHERE customer_key = {c};"),
    ("simple_select", "Show discounted prices of all lineitems",
     "SELECT DISCOUNT(l_extendedprice) FROM lineitem;"),
    ("simple_select", "List customer birthdays",
     "SELECT BIRTHDAY(c_name) FROM customer;"),
    ("single_table_where", "Which parts have a size from 10 to 20?",
     "SELECT p_name FROM part WHERE p_size BETWEEN 10 AND 20;"),
    ("anti_join_left_null", "Which order years have orders without lineitems?",
     "SELECT STRFTIME('%Y', o.o_orderdate) FROM orders o LEFT OUTER JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL;"),
    ("3_table_join", "List customers with their orders and lineitems",
     "SELECT c.c_name, l.l_quantity\nFROM customer c\nJOIN orders o ON c.c_custkey = o.o_custkey\nJOIN lineitem l ON o.o_orderkey = l.l_orderkey;"),
    ("single_table_where", "Which orders are neither finished nor open?",
     "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O');"),
]

# Share of each template in 1000 slots (slot = o_orderkey % 1000): the
# anti-join and 4+-join classes are rare (so the curation step has deficits
# to fill) and simple selects hold about half of all rows (a hot class).
TEMPLATE_WEIGHTS: list[int] = [2, 2, 1, 1, 1, 1, 1, 1, 25, 25, 30, 30, 25, 25, 25, 25, 2, 2, 20, 20,
                               30, 30, 91, 40, 333, 150, 2, 10, 10, 10, 10, 10, 10]
assert len(TEMPLATE_WEIGHTS) == len(EXAMPLE_TEMPLATES) and sum(TEMPLATE_WEIGHTS) == 1000


def _cumulative() -> list[int]:
    out, acc = [], 0
    for w in TEMPLATE_WEIGHTS:
        acc += w
        out.append(acc)
    return out


# Schema texts over the star schema, in the four notations plus invalid ones.
SCHEMA_TEXTS: list[str] = [
    # N1, constraint section with PK/FK, DECIMAL with a comma
    "region(r_regionkey INTEGER, r_name VARCHAR; PK(r_regionkey)); "
    "nation(n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER; PK(n_nationkey), FK(n_regionkey REFERENCES region(r_regionkey))); "
    "customer(c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR; PK(c_custkey), FK(c_nationkey REFERENCES nation(n_nationkey))); "
    "orders(o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DECIMAL(15,2), o_orderdate DATE, o_orderpriority VARCHAR; PK(o_orderkey), FK(o_custkey REFERENCES customer(c_custkey)))",
    # N2, newline separated, ';'-separated constraints, arrow FKs
    "customer(c_custkey INTEGER, c_name TEXT, c_nationkey INTEGER, c_acctbal REAL; PK(c_custkey); FK c_nationkey->nation(n_nationkey))\n"
    "nation(n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER; PK(n_nationkey))\n"
    "orders(o_orderkey INTEGER, o_custkey INTEGER, o_totalprice REAL, o_orderdate TEXT; PK(o_orderkey); FK o_custkey->customer(c_custkey))",
    # N3, PK/FK as the type word
    "Customer(c_custkey PK, c_name VARCHAR, c_acctbal FLOAT, c_mktsegment VARCHAR);\n"
    "Orders(o_orderkey PK, o_custkey FK, o_totalprice DECIMAL, o_orderdate DATE, o_orderpriority VARCHAR);\n"
    "Lineitem(l_orderkey FK, l_partkey FK, l_quantity INT, l_extendedprice DECIMAL, l_discount DECIMAL);",
    # N4, PRIMARY KEY(...) and FK(... REFERENCES ...), newline separated
    "part(p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INT, p_retailprice DOUBLE; PRIMARY KEY(p_partkey))\n"
    "supplier(s_suppkey BIGINT, s_name VARCHAR, s_nationkey INT, s_acctbal DOUBLE; PRIMARY KEY(s_suppkey); FK(s_nationkey REFERENCES nation(n_nationkey)))\n"
    "lineitem(l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE; PRIMARY KEY(l_orderkey, l_linenumber); FK(l_partkey REFERENCES part(p_partkey)))",
    # N1 with a wide table (more columns than the per-table limit)
    "lineitem(l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
    "l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate DATE, l_commitdate DATE, l_receiptdate DATE, "
    "l_shipmode VARCHAR, l_comment VARCHAR; PK(l_orderkey, l_linenumber), FK(l_partkey REFERENCES part(p_partkey))); "
    "part(p_partkey BIGINT, p_name VARCHAR, p_size INT; PK(p_partkey)); "
    "supplier(s_suppkey BIGINT, s_name VARCHAR; PK(s_suppkey))",
    # invalid ones
    "",
    fixed.SCHEMA_NOT_AVAILABLE,
    "x(a INT)",
]

# One of the schema texts gets a table of its customer's own (more columns than
# a card page), so the number of distinct schemas grows with the customers.
GROWING_SCHEMA = 1
OWN_TABLE = ("\nledger_{c}(entry_{c} INTEGER, c_custkey INTEGER, order_date DATE, "
             + ", ".join(f"amount_{i} REAL" for i in range(1, 22))
             + "; PK(entry_{c}); FK c_custkey->customer(c_custkey))")

# predictions: answer kinds picked by (ex_id * 7 + variant ordinal) % 6
N_ANSWER_KINDS = 6
FAIL_ANSWERS = ["ERROR: out of memory", "SKIPPED: Model not loaded", "SKIPPED: Model not loaded", "ERROR: Status 500"]


def _fill(template: Column, custkey: Column, priority: Column, year: Column) -> Column:
    out = F.replace(template, F.lit("{c}"), custkey.cast("string"))
    out = F.replace(out, F.lit("{p}"), priority)
    return F.replace(out, F.lit("{y}"), year.cast("string"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ex_id, db_id, question, SQL, db_schema, query_type_name -- one per order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    ns = len(SCHEMA_TEXTS)
    slot = F.col("o_orderkey") % 1000
    t_idx = None
    for i, bound in enumerate(_cumulative()):
        t_idx = F.when(slot < bound, F.lit(i + 1)) if t_idx is None else t_idx.when(slot < bound, F.lit(i + 1))
    s_idx = (F.col("o_custkey") % ns).cast("int")
    q_arr = F.array(*[F.lit(q) for _, q, _ in EXAMPLE_TEMPLATES])
    s_arr = F.array(*[F.lit(s) for _, _, s in EXAMPLE_TEMPLATES])
    c_arr = F.array(*[F.lit(c) for c, _, _ in EXAMPLE_TEMPLATES])
    d_arr = F.array(*[F.lit(s) for s in SCHEMA_TEXTS])
    c, p, y = F.col("o_custkey"), F.col("o_orderpriority"), F.year("o_orderdate")
    own = _fill(F.lit(OWN_TABLE), c, p, y)
    return o.select(
        F.col("o_orderkey").alias("ex_id"),
        F.concat(F.lit("tpch_"), s_idx.cast("string")).alias("db_id"),
        _fill(F.element_at(q_arr, t_idx), c, p, y).alias("question"),
        _fill(F.element_at(s_arr, t_idx), c, p, y).alias("SQL"),
        F.when(s_idx == GROWING_SCHEMA, F.concat(F.element_at(d_arr, s_idx + 1), own))
         .otherwise(F.element_at(d_arr, s_idx + 1)).alias("db_schema"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.element_at(c_arr, t_idx)).alias("query_type_name"),
    )


def predictions_from(ex: DataFrame) -> DataFrame:
    """ex_id, variant, raw_answer: one simulated model answer per variant."""
    sql = F.col("SQL")
    kind = (F.col("ex_id") * 7 + F.col("ord")) % N_ANSWER_KINDS
    spaced = F.replace(F.lower(sql), F.lit(" "), F.lit("  "))
    echo = F.concat(
        F.when(F.coalesce(F.length("db_schema"), F.lit(0)) > 0,
               F.concat(F.lit(fixed.EVAL_PROMPT.split("{schema}")[0]), F.col("db_schema"),
                        F.lit(fixed.EVAL_PROMPT.split("{schema}")[1].split("{question}")[0]), F.col("question"),
                        F.lit(fixed.EVAL_PROMPT.split("{question}")[1])))
         .otherwise(F.concat(F.lit(fixed.EVAL_PROMPT_NO_SCHEMA.split("{question}")[0]), F.col("question"),
                             F.lit(fixed.EVAL_PROMPT_NO_SCHEMA.split("{question}")[1]))),
        F.lit("  "), spaced)
    fence = (F.when(F.col("ex_id") % 10 == 9, F.concat(F.lit("```python\n"), sql, F.lit("\n```")))
              .when(F.col("ex_id") % 2 == 0,
                    F.concat(F.lit("Here is the query:\n```sql\n"), sql, F.lit("\n```\nThis answers the question.")))
              .otherwise(F.concat(F.lit("```\n"), sql, F.lit("\n```"))))
    fails = F.element_at(F.array(*[F.lit(x) for x in FAIL_ANSWERS]), F.col("ord") + 1)
    raw = (F.when(kind == 0, sql)
            .when((kind == 1) & (F.col("ord") < 2), echo)
            .when(kind == 1, F.concat(F.lit("\n"), spaced, F.lit("  ")))
            .when(kind == 2, fence)
            .when(kind == 3, F.regexp_replace(sql, ";$", ""))
            .when(kind == 4, F.replace(sql, F.lit("SELECT "), F.lit("SELECT DISTINCT ")))
            .otherwise(fails))
    return (ex.select("ex_id", "question", "SQL", "db_schema",
                      F.posexplode(variants_array()).alias("ord", "variant"))
              .select("ex_id", "variant", raw.alias("raw_answer")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_from(examples(spark, sf_dir))


# ----------------------------------------------------------------------------
# DuckDB text of the same derivation (oracle side)
# ----------------------------------------------------------------------------

def duck_str(s: str) -> str:
    """A DuckDB string literal (newlines spelled with chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")" if len(parts) > 1 else quoted[0]


def duck_list(items: list[str]) -> str:
    return "[" + ", ".join(duck_str(x) for x in items) + "]"


def _duck_fill(t: str) -> str:
    return (f"replace(replace(replace({t}, '{{c}}', CAST(o_custkey AS VARCHAR)), '{{p}}', o_orderpriority), "
            f"'{{y}}', CAST(year(o_orderdate) AS VARCHAR))")


def duck_examples_sql() -> str:
    ns = len(SCHEMA_TEXTS)
    t_idx = "CASE " + " ".join(f"WHEN o_orderkey % 1000 < {b} THEN {i + 1}" for i, b in enumerate(_cumulative())) + " END"
    q = duck_list([q for _, q, _ in EXAMPLE_TEMPLATES])
    s = duck_list([s for _, _, s in EXAMPLE_TEMPLATES])
    c = duck_list([c for c, _, _ in EXAMPLE_TEMPLATES])
    d = duck_list(SCHEMA_TEXTS)
    return f"""SELECT o_orderkey AS ex_id,
  'tpch_' || CAST(CAST(o_custkey % {ns} AS INTEGER) AS VARCHAR) AS db_id,
  {_duck_fill(f"list_extract({q}, {t_idx})")} AS question,
  {_duck_fill(f"list_extract({s}, {t_idx})")} AS "SQL",
  CASE WHEN o_custkey % {ns} = {GROWING_SCHEMA} THEN list_extract({d}, {GROWING_SCHEMA + 1}) || {_duck_fill(duck_str(OWN_TABLE))}
       ELSE list_extract({d}, CAST(o_custkey % {ns} AS INTEGER) + 1) END AS db_schema,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE list_extract({c}, {t_idx}) END AS query_type_name
FROM orders"""


def duck_eval_prompt(question: str, schema: str) -> str:
    a = fixed.EVAL_PROMPT.split("{schema}")
    b = a[1].split("{question}")
    n = fixed.EVAL_PROMPT_NO_SCHEMA.split("{question}")
    return (f"CASE WHEN coalesce(length({schema}), 0) > 0 THEN {duck_str(a[0])} || {schema} || {duck_str(b[0])} || "
            f"{question} || {duck_str(b[1])} ELSE {duck_str(n[0])} || {question} || {duck_str(n[1])} END")


def duck_predictions_sql() -> str:
    variants = ", ".join(f"({i}, '{v}')" for i, (v, _) in enumerate(fixed.VARIANTS))
    fails = duck_list(FAIL_ANSWERS)
    kind = f"((e.ex_id * 7 + v.ord) % {N_ANSWER_KINDS})"
    spaced = "replace(lower(e.\"SQL\"), ' ', '  ')"
    return f"""SELECT e.ex_id, v.variant,
  CASE WHEN {kind} = 0 THEN e."SQL"
       WHEN {kind} = 1 AND v.ord < 2 THEN {duck_eval_prompt('e.question', 'e.db_schema')} || '  ' || {spaced}
       WHEN {kind} = 1 THEN chr(10) || {spaced} || '  '
       WHEN {kind} = 2 THEN
         CASE WHEN e.ex_id % 10 = 9 THEN '```python' || chr(10) || e."SQL" || chr(10) || '```'
              WHEN e.ex_id % 2 = 0 THEN 'Here is the query:' || chr(10) || '```sql' || chr(10) || e."SQL" || chr(10) || '```' || chr(10) || 'This answers the question.'
              ELSE '```' || chr(10) || e."SQL" || chr(10) || '```' END
       WHEN {kind} = 3 THEN regexp_replace(e."SQL", ';$', '')
       WHEN {kind} = 4 THEN replace(e."SQL", 'SELECT ', 'SELECT DISTINCT ')
       ELSE list_extract({fails}, v.ord + 1) END AS raw_answer
FROM examples e, (VALUES {variants}) AS v(ord, variant)"""


def duck_targets_sql() -> str:
    rows = ", ".join(f"('{q}', {t}, {i})" for i, (q, t) in enumerate(fixed.TARGETS))
    return f"SELECT * FROM (VALUES {rows}) AS t(query_type, target, ord)"


def duck_ctes(*names: str) -> str:
    """``WITH`` clause defining the requested fixtures (and what they need)."""
    defs = {
        "examples": duck_examples_sql,
        "predictions": duck_predictions_sql,
        "targets": duck_targets_sql,
    }
    needed = list(names)
    if "predictions" in needed and "examples" not in needed:
        needed.insert(0, "examples")
    order = [n for n in defs if n in needed]
    return "WITH " + ",\n".join(f"{n} AS ({defs[n]()})" for n in order) + "\n"
