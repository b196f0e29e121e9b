"""JSON-lines sources and sinks (O-IO-1..7).

A line is parsed once, into a map from its keys to variants: keys are case
sensitive (a file may carry both ``SQL`` and ``sql``), every field keeps its
type, and a record can be written back whole with one field replaced.  Blank
lines are skipped, and ``#`` lines on request.  The file order that head/tail
selections depend on is an explicit ordinal: file path, start of the split,
then a row number that grows along the split.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.session import scratch_path

EXAMPLE_FIELDS = ["ex_id", "db_id", "question", "SQL", "db_schema", "query_type", "query_type_name"]
RECORD = "map<string,variant>"
ORD = "struct<file:string,split:bigint,row:bigint>"


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _every_line(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                          F.monotonically_increasing_id().alias("row")).alias("ord"))


def _lines(spark: SparkSession, path: str, skip_comments: bool) -> DataFrame:
    t = _every_line(spark, path)
    s = strip(F.col("value"))
    keep = (s != "") & ~s.startswith("#") if skip_comments else s != ""
    return t.filter(keep).withColumn("record", F.from_json("value", RECORD))


def field(name: str) -> Column:
    """A field of the record as text; ``sql`` stands in for a missing ``SQL``."""
    get = lambda k: F.try_variant_get(F.try_element_at("record", F.lit(k)), "$", "string")
    return F.coalesce(get("SQL"), get("sql")) if name == "SQL" else get(name)


def read_jsonl(spark: SparkSession, path: str, skip_comments: bool = False, fields: list[str] = EXAMPLE_FIELDS,
               on_malformed: str = "fail", keep_record: bool = False) -> DataFrame:
    """Rows of a JSON-lines file or folder (O-IO-1), without ``#`` lines when
    ``skip_comments`` (O-IO-2): ``ord`` (O-IO-7), the fields as text, and with
    ``keep_record`` the whole record.

    A line that is no JSON object stops the job (``on_malformed="fail"``) or is
    left out (``"drop"``; ``malformed_lines`` counts those).
    """
    if on_malformed not in ("fail", "drop"):
        raise ValueError("on_malformed must be 'fail' or 'drop'")
    t = _lines(spark, path, skip_comments)
    if on_malformed == "drop":
        t = t.filter(F.col("record").isNotNull())
    else:
        where = F.concat(F.lit("malformed JSON line in "), F.col("ord.file"), F.lit(": "), F.left("value", F.lit(80)))
        t = t.withColumn("record", F.coalesce(F.col("record"), F.raise_error(where).cast(RECORD)))
    return t.select("ord", *(["record"] if keep_record else []), *(field(f).alias(f) for f in fields))


KINDS = ("record", "malformed", "comment", "blank")


def read_with_rejects(spark: SparkSession, path: str, skip_comments: bool = True,
                      fields: list[str] = EXAMPLE_FIELDS) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(records, rejects, counts) of a JSON-lines file or folder, from one scan.

    Every line is sorted into one of ``KINDS`` and written to a table in the
    session's scratch folder, a folder per kind; the counts are taken as the
    lines pass.  ``records`` has what ``read_jsonl`` gives; ``rejects`` (kind,
    ord, value) all other lines.  With ``skip_comments=False`` a ``#`` line is
    malformed.
    """
    s = strip(F.col("value"))
    lines = _every_line(spark, path).withColumn("record", F.from_json("value", RECORD))
    kind = F.when(s == "", "blank").when(s.startswith("#") & F.lit(skip_comments), "comment") \
        .when(F.col("record").isNull(), "malformed").otherwise("record")
    seen = Observation()
    sorted_lines = lines.withColumn("kind", kind).observe(
        seen, *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
    folder = scratch_path(spark, "json-lines")
    kept = F.col("kind") != "record"
    sorted_lines.select("kind", "ord", F.when(kept, F.col("value")).alias("value"),
                        *(F.when(~kept, field(f)).alias(f) for f in fields)).write.partitionBy("kind").parquet(folder)
    back = spark.read.schema(f"ord {ORD}, value string, " + ", ".join(f"`{f}` string" for f in fields) + ", kind string").parquet(folder) \
        if sum(seen.get.values()) else spark.createDataFrame([], f"ord {ORD}, value string, " + ", ".join(
            f"`{f}` string" for f in fields) + ", kind string")
    return (back.filter(F.col("kind") == "record").select("ord", *fields),
            back.filter(F.col("kind") != "record").select("kind", "ord", "value"), dict(seen.get))


def malformed_lines(spark: SparkSession, path: str, skip_comments: bool = False) -> DataFrame:
    """file, n_malformed: lines that are no JSON object."""
    t = _lines(spark, path, skip_comments).filter(F.col("record").isNull())
    return t.groupBy(F.col("ord.file").alias("file")).agg(F.count(F.lit(1)).alias("n_malformed"))


def with_position_id(rows: DataFrame, name: str = "ex_id") -> DataFrame:
    """``name`` from the place in the input: equal rows get different ids."""
    place = F.concat_ws(":", "ord.file", F.col("ord.split").cast("string"), F.col("ord.row").cast("string"))
    return rows.withColumn(name, place)


def prefer_source(spark: SparkSession, paths: list[str], skip_comments: bool = True) -> DataFrame:
    """Read the first path that exists (O-IO-3); no rows when none does."""
    for p in paths:
        if _fs_exists(spark, p):
            return read_jsonl(spark, p, skip_comments)
    return spark.createDataFrame([], "ord " + ORD + ", " + ", ".join(f"{f} string" for f in EXAMPLE_FIELDS))


def require_source(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read ``path`` or fail with FileNotFoundError (O-IO-4)."""
    if not _fs_exists(spark, path):
        raise FileNotFoundError(path)
    return read_jsonl(spark, path, **options)


def record_with(name: str, value: Column) -> Column:
    """The record as a JSON line with the text field ``name`` replaced (put at
    the end when the record lacks it)."""
    new = value.cast("variant")
    replaced = F.transform_values("record", lambda k, v: F.when(k == name, new).otherwise(v))
    added = F.map_concat("record", F.create_map(F.lit(name), new))
    return F.to_json(F.when(F.map_contains_key("record", name), replaced).otherwise(added),
                     {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = True) -> None:
    """One UTF-8 JSON object per line (non-ASCII unescaped) (O-IO-5)."""
    df.write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def report_metadata(total: int, prune: tuple[int, int], models: dict[str, str], only_valid: bool = True) -> dict:
    """The metadata block of the evaluation report, but for its time."""
    return {
        "total_examples": total, "models": models,
        "schema_pruning": {"tested_both": True, "min_tables": prune[0], "max_columns": prune[1]},
        "dataset_filter": {"only_valid_schemas": only_valid, "schema_required": only_valid},
    }


def report_summary(overall: DataFrame, metadata: dict, variants: list[str]) -> DataFrame:
    """One JSON line (O-IO-6): metadata, overall_accuracy by variant name,
    pruning_comparison, and n_missing predictions."""
    return overall.select(F.to_json(F.struct(
        F.parse_json(F.lit(json.dumps(metadata))).alias("metadata"),
        F.struct(*[F.col(f"{v}_acc").alias(v) for v in variants]).alias("overall_accuracy"),
        F.struct(F.col("pruning_difference").alias("difference"), F.col("pruning_helps"),
                 F.col("pruning_hurts")).alias("pruning_comparison"), "n_missing")).alias("value"))


def write_report(path: str, metadata: dict, overall: DataFrame, by_type: DataFrame, results: DataFrame,
                 variants: list[str]) -> None:
    """Evaluation report (O-IO-6): the summary line plus the report tables,
    each its own JSON-lines table (results are a table, not an array embedded
    in one document)."""
    from datetime import datetime, timezone
    base = path.rstrip("/")
    stamped = {"evaluated_at": datetime.now(timezone.utc).isoformat()} | metadata
    report_summary(overall, stamped, variants).coalesce(1).write.mode("overwrite").text(f"{base}/summary")
    write_jsonl(by_type, f"{base}/by_type")
    write_jsonl(results, f"{base}/results")
