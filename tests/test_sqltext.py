import itertools
import re

from conftest import col_values
from pyspark.sql import functions as F

from tessera.functions import sqltext as st


def test_normalize(spark):
    got = col_values(spark, st.normalize_sql, ["```sql\nSELECT 1\n```", "SELECT a FROM t;;", "  a \n\t b ; ", None, "```SQL x```"])
    assert got == ["SELECT 1", "SELECT a FROM t;", "a b", "", "x"]


def test_tables(spark):
    f = lambda c: F.sort_array(st.extract_tables(st.normalize_sql(c)))
    got = col_values(spark, f, ['SELECT * FROM "db"."t"', "SELECT a FROM [dbo].[t]", "SELECT a FROM s.t, u",
                                "SELECT a FROM x JOIN Y ON 1", "SELECT EXTRACT(YEAR FROM d) FROM t"])
    assert got == [['"t'], ["[t"], ["t"], ["x", "y"], ["d", "t"]]


def test_columns(spark):
    f = lambda c: F.sort_array(st.extract_columns(st.normalize_sql(c)))
    got = col_values(spark, f, ["SELECT COUNT(x), t1.name FROM t1", "SELECT f(g(a), b) FROM t", "UPDATE t SET a = 1"])
    assert got == [["name"], ["b", "f"], []]


def _score(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, g string")
    df = st.with_sql_features(st.with_sql_features(df, "p", "pf"), "g", "gf")
    return [r[0] for r in df.select(st.semantic_score(F.col("pf"), F.col("gf"))).collect()]


def test_score_edges(spark):
    s = _score(spark, [("SELECT a FROM t", "SELECT a FROM t"), ("", ""), ("SELECT a FROM t", ""),
                       ("SELECT a FROM t", "select A from T;")])
    assert s == [1.0, 1.0, 0.0, 1.0]


def test_score_symmetric(spark):
    pairs = [("SELECT a, b FROM t WHERE x = 1", "SELECT a FROM t JOIN u ON 1 GROUP BY a"),
             ("SELECT COUNT(*) FROM t", "SELECT DISTINCT c FROM t ORDER BY c")]
    assert _score(spark, pairs) == _score(spark, [(g, p) for p, g in pairs])


def test_answer_cleaning(spark):
    got = col_values(spark, st.extract_sql_answer, [
        "```sql\nSELECT 1\n```", "text ```\nSELECT 2\n``` more", "```python\nprint(1)\n```", " SELECT 3 ",
        "```sql\nSELECT 4"])
    assert got == ["SELECT 1", "SELECT 2", "python\nprint(1)", "SELECT 3", "SELECT 4"]


def test_exact_match(spark):
    df = spark.createDataFrame([("select  a\nfrom t", "SELECT a FROM t"), ("SELECT a FROM t;", "SELECT a FROM t")], "p string, g string")
    assert [r[0] for r in df.select(st.exact_match(F.col("p"), F.col("g"))).collect()] == [True, False]


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plain_features_equal_the_general_ones(spark):
    texts = ["SELECT COUNT(x), t1.name, t11 FROM [dbo].[T] JOIN a.b ON 1", "select 1from_ FROM1 x; (Select y from \"t\" GROUP  BY z)",
             "", None, "SELECT1 COUNT1 _SELECT sum(a) ORDER BY b", "SELECT a FROM \"\" JOIN c. JOIN .d JOIN c", "SELECT ıs, a FROM été",
             "select\x1cfrom\x1da from b union c", "SELECT DISTINCT in_x, t10, t100, selects, as1 FROM t LIMIT 1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    both = st.with_sql_features(df, "t", "f").withColumn("n", st.normalize_sql(F.col("t"))) \
        .withColumn("g", st.features_of_normalized(F.col("n")))
    for k in st.FEATURES:
        for r in both.select("t", F.sort_array(F.col("f")[k]), F.sort_array(F.col("g")[k])).collect():
            assert r[1] == r[2], (k, r[0])


def test_normalize_order_of_steps(spark):
    texts = ["a;\n", " ; ", "a ; ;", "a;;", "a \n ;", "a\x1c;\x1d", "```sql a;``` ;", "a\u2028\u00a0b;", "a;\tb", ";", "\ta  b\r\nc "]
    assert col_values(spark, st.normalize_sql, texts) == ["a", "", "a ;", "a;", "a", "a", "a;", "a b", "a; b", "", "a b c"]


def test_features_of_names_and_words_with_odd_signs(spark):
    runs = ["".join(x) for n in (1, 2, 3) for x in itertools.product("`\"[].a", repeat=n)]
    texts = [f"SELECT b FROM {x} JOIN {x[::-1]}c" for x in runs] + \
        ["foin x jrom y from1 z xjoin w JOIN from v", "1SELECT a 1FROM b GROUP BY1 c", "GROUP1 group by COUNT2 (select2 sum( SELECT 1",
         "case9 case from from_ order  by", "select a from2 b from c", "Selects x select (a, f(b), in1) as t10, t11 FROM t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = st.with_sql_features(df, "t", "f").withColumn("n", st.normalize_sql(F.col("t"))) \
        .withColumn("g", st.features_of_normalized(F.col("n")))
    sets = [F.sort_array(F.col(x)[k]) for x in "fg" for k in st.FEATURES]
    for r in both.select("t", *sets).collect():
        assert r[1:6] == r[6:], r["t"]


def test_plain_text_is_searched_once_for_words_tables_and_columns(spark):
    df = spark.createDataFrame([("SELECT a FROM t",)], "t string")
    stages = _executed(st.with_sql_features(df, "t", "f")).split("\n")
    low = [n for x in stages for n in re.findall(r"regexp_extract_all\((?:upper\()?_f_(?:low|up)#", x)]
    # tokens, whole words where a digit stands beside a letter, tables; before: also clauses and keywords by lists of words
    assert len(low) == 3


def test_scores_take_no_union_of_sets(spark):
    df = spark.createDataFrame([("SELECT a, b FROM t", "SELECT a FROM t JOIN u")], "p string, g string")
    df = st.with_sql_features(st.with_sql_features(df, "p", "pf"), "g", "gf").select(st.semantic_score(F.col("pf"), F.col("gf")).alias("s"))
    assert "array_union" not in _executed(df)
    assert abs(df.first()[0] - (0.25 / 2 + 0.25 / 2 + 0.25 * 2 / 3 + 0.15 * 2 / 3 + 0.10 * 4 / 7)) < 1e-12


def test_only_texts_with_unusual_whitespace_are_translated(spark):
    from tessera.functions.text import EXOTIC_WS, ascii_ws, squash_ws
    df = spark.createDataFrame([("a b",), ("a" + EXOTIC_WS + "b",), ("é \t c",), (None,)], "x string")
    plan = _executed(df.select(ascii_ws(F.col("x")).alias("y")))
    assert "CASE WHEN RLIKE(x" in plan
    assert [r[0] for r in df.select(squash_ws(F.col("x"))).collect()] == ["a b", "a b", "é c", None]
