import re

from conftest import col_values
from pyspark.sql import functions as F

from tessera.functions.schema_text import parse_schema, question_tokens, reformat_schema
from tessera.operators.schema_ops import prune_schemas

N1 = "table1(col1 TYPE, col2 TYPE; PK(col1), FK(col2 REFERENCES table2(id))); table2(id INT, name TEXT)"
N3 = ("Student(student_id PK, name VARCHAR, age INT);\n"
      "Enrollment(enrollment_id PK, student_id FK, course_id FK, grade VARCHAR);")


def test_parse_observed(spark):
    t = col_values(spark, parse_schema, [N1])[0]
    assert [x["key"] for x in t] == ["table1", "table2"]
    assert [(c["name"], c["type"]) for c in t[0]["columns"]] == [("col1", "TYPE"), ("col2", "TYPE")]
    assert t[0]["pks"] == ["col1"] and t[0]["fks"] == []          # FK(...) never parses (capture stops at ')')
    assert [(c["name"], c["type"]) for c in t[1]["columns"]] == [("id", "INT"), ("name", "TEXT)")]


def test_parse_duplicates_keep_first_position_last_value(spark):
    t = col_values(spark, parse_schema, ["a(x INT, y INT, x TEXT); b(z INT); A(w INT)"])[0]
    assert [x["name"] for x in t] == ["A", "b"]
    assert [(c["name"], c["type"]) for c in t[0]["columns"]] == [("w", "INT)")]  # last table keeps its ')' (Q4)
    t2 = col_values(spark, parse_schema, ["a(x INT, y INT, x TEXT)"])[0]
    assert [(c["name"], c["type"]) for c in t2[0]["columns"]] == [("x", "TEXT)"), ("y", "INT")]


def test_question_tokens(spark):
    got = col_values(spark, lambda c: F.sort_array(question_tokens(c)), ["What is the name of each table2 entry?"])[0]
    assert got == ["description", "entry", "label", "name", "table2", "title"]


def _prune(spark, rows, mt, mc):
    df = spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(rows)], "ex_id int, db_schema string, question string")
    return [r["pruned_schema"] for r in prune_schemas(df, mt, mc, mode="observed").orderBy("ex_id").collect()]


def test_prune_golden(spark):
    got = _prune(spark, [
        (N1, "What is the name of each table2 entry?"),
        (N3, "List students not enrolled in any course"),
        ("t(a INT, b INT, c INT, d INT, e INT; PK(a))", "x y"),
        ("", "anything"),
        ("no parens here", "anything"),
    ], 2, 2)
    assert got[0] == "table1(col1 TYPE, col2 TYPE; PK(col1))); table2(id INT, name TEXT)))"
    assert got[2] == "t(a INT, d INT; PK(a)))"
    assert got[3] == "" and got[4] == "no parens here"
    got1 = _prune(spark, [(N1, "What is the name of each table2 entry?")], 1, 10)
    assert got1 == ["table2(id INT, name TEXT)))"]
    got2 = _prune(spark, [(N3, "List students not enrolled in any course")], 2, 12)
    assert got2 == ["Student(student_id PK, name VARCHAR, age INT)); "
                    "Enrollment(enrollment_id PK, student_id FK, course_id FK, grade VARCHAR))"]


def test_prune_min_tables_fallback_by_name(spark):
    # no table name matches 'grade': the min-tables top-up takes names in descending order
    got = _prune(spark, [(N3, "which grade")], 1, 10)[0]
    assert got == "Student(student_id PK, name VARCHAR, age INT))"


def test_reformat(spark):
    s = "game(id INTEGER, genre_id INTEGER; PK(id); FK genre_id->genre(id))\ngame_platform(id INTEGER, game_id INTEGER)"
    got = col_values(spark, reformat_schema, [s])[0]
    assert got == ("Table: game\n  - id INTEGER\n  - genre_id INTEGER\n  - PK(id)\n  FK genre_id->genre(id)\n\n"
                   "Table: game_platform\n  - id INTEGER\n  - game_id INTEGER")


def test_documented_parse_all_notations(spark):
    from tessera.functions.schema_text import parse_schema_documented
    n2 = "game(id INTEGER, genre_id INTEGER; PK(id); FK genre_id->genre(id))\ngenre(id INTEGER, name TEXT)"
    n4 = "t(a INT, b DECIMAL(10,2); PRIMARY KEY(a); FK(b REFERENCES u(x)))\nu(x INT)"
    n1 = "t(a INT; PK(a), FK(a REFERENCES u(x))); u(x INT, y TEXT; FOREIGN KEY(y) REFERENCES t(a))"
    got = col_values(spark, parse_schema_documented, [n2, N3, n4, n1])
    g2, g3, g4, g1 = got
    assert [t["key"] for t in g2] == ["game", "genre"] and g2[0]["pks"] == ["id"]
    assert [tuple(f) for f in g2[0]["fks"]] == [("genre_id", "genre", "id")]
    assert [t["key"] for t in g3] == ["student", "enrollment"] and g3[0]["pks"] == ["student_id"]
    assert [f["col"] for f in g3[1]["fks"]] == ["student_id", "course_id"]
    assert [(c["name"], c["type"]) for c in g4[0]["columns"]] == [("a", "INT"), ("b", "DECIMAL(10,2)")]
    assert g4[0]["pks"] == ["a"] and [tuple(f) for f in g4[0]["fks"]] == [("b", "u", "x")]
    assert [tuple(f) for f in g1[1]["fks"]] == [("y", "t", "a")]


def test_documented_prune_follows_foreign_keys(spark):
    s = ("region(r_id INT, r_name TEXT; PK(r_id)); nation(n_id INT, n_name TEXT, r_id INT; PK(n_id), "
         "FK(r_id REFERENCES region(r_id))); customer(c_id INT, c_name TEXT, n_id INT; PK(c_id), FK(n_id REFERENCES nation(n_id)))")
    df = spark.createDataFrame([(0, s, "customer names")], "ex_id int, db_schema string, question string")
    got = prune_schemas(df, 1, 10, mode="documented").collect()[0]["pruned_schema"]
    # customer matches; nation is referenced by it (one hop); region is not reached
    assert got == ("nation(n_id INT, n_name TEXT, r_id INT; PK(n_id), FK(r_id REFERENCES region(r_id))); "
                   "customer(c_id INT, c_name TEXT, n_id INT; PK(c_id), FK(n_id REFERENCES nation(n_id)))")


def test_reformat_documented(spark):
    from tessera.functions.schema_text import reformat_schema_documented
    s = "game(id INTEGER, genre_id INTEGER; PK(id); FK genre_id->genre(id))\ngame_platform(id INTEGER, game_id INTEGER)"
    got = col_values(spark, reformat_schema_documented, [s])[0]
    assert got == ("Table: game\n  - id: INTEGER (PRIMARY KEY)\n  - genre_id: INTEGER (FOREIGN KEY -> genre.id)\n\n"
                   "Table: game_platform\n  - id: INTEGER\n  - game_id: INTEGER")


def _documented(spark, schema, question, mt, mc):
    df = spark.createDataFrame([(0, schema, question)], "ex_id int, db_schema string, question string")
    return prune_schemas(df, mt, mc).collect()[0]["pruned_schema"]      # documented is the default


STAR = ("aaa(a_id INT; PK(a_id)); hub(h_id INT, h_a INT; PK(h_id), FK(h_a REFERENCES aaa(a_id))); "
        "leaf1(l1 INT; FK(l1 REFERENCES hub(h_id))); leaf2(l2 INT; FK(l2 REFERENCES hub(h_id))); zzz(z INT)")


def test_documented_referencing_table_is_added(spark):
    # only hub matches; aaa is referenced by it, leaf1 and leaf2 refer to it, zzz has no link
    got = _documented(spark, STAR, "hub", 1, 10)
    assert [t.split("(")[0] for t in got.split("; ") if not t.startswith(("PK", "FK"))] == ["aaa", "hub", "leaf1", "leaf2"]


def test_documented_min_tables_by_fk_degree(spark):
    # nothing matches: the degrees are hub 3, aaa 1, leaf1 1, leaf2 1, zzz 0; ties go by name, descending
    assert _documented(spark, STAR, "nothing here", 1, 10).startswith("hub(")
    got = _documented(spark, STAR, "nothing here", 2, 10)
    assert [t.split("(")[0] for t in got.split("; ") if not t.startswith(("PK", "FK"))] == ["hub", "leaf2"]


def test_documented_fk_columns_rank_before_matches(spark):
    s = "things(a INT, b INT, c INT, size INT, d INT; PK(a), FK(d REFERENCES u(x))); u(x INT)"
    got = _documented(spark, s, "things size", 1, 2)
    assert got.startswith("things(a INT, d INT; PK(a), FK(d REFERENCES u(x)))")


def test_wide_table_duplicates(spark):
    cols = [f"c{i % 700} T{i}" for i in range(1000)]
    t = col_values(spark, parse_schema, [f"w({', '.join(cols)}; PK(c0)); x(a INT)"])[0][0]
    assert [c["name"] for c in t["columns"]] == [f"c{i}" for i in range(700)]
    assert [c["type"] for c in t["columns"]] == [f"T{i + 700 if i < 300 else i}" for i in range(700)]


def test_matcher_agrees_with_name_matches(spark):
    """Names and tokens that lie in each other, of one and two characters, with
    underscores and commas."""
    from tessera.functions.schema_text import _matcher, name_matches
    names = ["a", "ab", "x_ab", "ab_x", "x__ab", "abc", "xabcx", "f(a,b)", "o_totalprice", "price", "_", "", "a_b", "2)", "é_ab"]
    tokens = [[], ["a"], ["ab"], ["abc"], ["xabc", "cxa"], ["_a"], ["a_"], ["totalprice", "ab"], ["prices"], ["price", "f", "a", "b"], ["é", "éa"], ["a_b_c"], ["__a"]]
    tables = F.array(F.struct(F.lit("").alias("key"), F.array(F.struct(F.col("n").alias("name"))).alias("columns"),
                              F.array().cast("array<string>").alias("pks"), F.array(F.struct(F.lit("ab").alias("col"))).alias("fks")))
    rows = spark.createDataFrame([(n, t) for n in names for t in tokens], "n string, t array<string>")
    got = rows.select("n", "t", name_matches(F.col("n"), F.col("t")).alias("want"),
                      _matcher(tables, F.col("t"))(lambda matches: matches(F.col("n"))).alias("got")).collect()
    assert [r for r in got if r["want"] != r["got"]] == [] and {r["want"] for r in got} == {True, False}


def test_membership_binds_a_struct_field_first(spark):
    from tessera.functions.schema_text import has
    df = spark.createDataFrame([(["a", "c"], [("a", 1), ("b", 2), ("c", 3)])], "names array<string>, s array<struct<k:string,v:int>>")
    kept = df.select(F.filter("s", lambda x: has(F.col("names"), x["k"])).alias("kept"))
    assert [x["k"] for x in kept.first()[0]] == ["a", "c"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"array_contains\(names#\d+, lambda \w+#\d+\)", plan)


def test_prune_plan_is_made_once_per_schema(spark):
    """What does not depend on the question is found below the join with the
    catalog, and pruning from it gives what pruning a parsed schema gives."""
    from tessera.functions.schema_text import parse_schema_documented, prune_parsed, question_tokens
    from tessera.operators.schema_ops import prune_schemas
    text = "a(id INT, b_id INT, x DECIMAL(10,2), y INT, z INT; PK(id), FK(b_id REFERENCES b(id))); b(id INT, name TEXT; PK(id)); c(w INT)"
    rows = [(i, q, s) for i, (q, s) in enumerate([("which name", text), ("sum of x and y", text), ("", text), (None, text), ("w", text), ("a", ""), ("a", None)])]
    df = spark.createDataFrame(rows, "i int, question string, db_schema string")
    pruned = prune_schemas(df, 2, 3)
    plan = pruned._jdf.queryExecution().optimizedPlan().toString()
    assert "ranked" in plan[plan.index("Join"):]
    one = df.select("i", prune_parsed(parse_schema_documented(F.col("db_schema")), question_tokens(F.col("question")), F.col("db_schema"), 2, 3, documented=True))
    got = sorted(pruned.select("i", "pruned_schema").collect())
    assert got == sorted(one.collect())
    # "which" lies around the name c; of equal columns the last by name stays
    assert got[0][1] == "a(id INT, b_id INT, z INT; PK(id), FK(b_id REFERENCES b(id))); b(id INT, name TEXT; PK(id)); c(w INT)"
