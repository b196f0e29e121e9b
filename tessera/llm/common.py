"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.session import scratch_path
from tessera.sources.tables import table

BATCH_ROWS = 1000

__all__ = ["table", "bounded_batches", "materialize", "drop_table", "id_marks", "range_of", "fold", "text_or_empty", "held_out",
           "one_label_per_document", "one_text_per_document", "tokenizer_file"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the session's shared checkpoint
    folder and read it back: the lineage is cut, and a lost executor rereads
    files instead of recomputing the whole plan."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads
    any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_marks(rows: DataFrame, column: str, ranges: int) -> list[int]:
    """Ascending ids that cut ``rows`` into about ``ranges`` ranges of equally
    many rows (approximate quantiles of one long column); the first one is the
    smallest id.  Empty if there is no id."""
    shares = [(i + 1) / ranges for i in range(ranges - 1)] or [0.5]
    low, cuts = rows.agg(F.min(column), F.percentile_approx(column, shares, max(10_000, 20 * ranges))).first()
    return [] if low is None else sorted({low, *cuts})


def range_of(column: str, marks: list[int]) -> Column:
    """Number of the range that an id falls into: of the marks after the first
    that are up to it, found in two steps of about the root of their number.
    Null ids fall into the last range."""
    later = marks[1:]
    if not later:
        return F.lit(0)
    step = max(1, int(len(later) ** 0.5))
    chunks = [later[i:i + step] for i in range(0, len(later), step)]
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col(column)))
    chunk = upto(F.lit([c[0] for c in chunks]))
    inside = F.get(F.array(*(F.lit(c) for c in chunks)), chunk - 1)
    return (F.when(F.col(column).isNull(), len(later)).when(chunk == 0, 0)
            .otherwise((chunk - 1) * step + upto(inside)).cast("int"))


def bounded_batches(df: DataFrame) -> None:
    """Hand texts to Python in batches of ``BATCH_ROWS`` rows instead of
    Spark's default of 10,000, which suits short rows: a batch is held several
    times over on its way.  A size that the cluster or the user chose stays,
    the default's own number included."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_ROWS))


def one_text_per_document(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys``, text: of several texts of one id the smallest, so that a sample
    of ids is as bounded in rows.  Combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.min("text").alias("text"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id written as text, modulo ``k`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % k


def held_out(doc_id: str, k: int, remainder: int) -> Column:
    """Whether a document's labels are hidden from training.  A null id has no
    fold and counts as held out."""
    return F.coalesce(fold(doc_id, k) == remainder, F.lit(True))


def one_label_per_document(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): repeated label rows collapse to their smallest label;
    null ids and null labels teach nothing."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
            .groupBy("doc_id").agg(F.min(column).cast("int").alias("label")))


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on this machine.  An absolute path is
    returned as is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)
