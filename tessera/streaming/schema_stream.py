"""Pruning and prompts on a stream (O-SCH-9, O-PR-2), each schema parsed once.

The parsed catalog is a table that grows with the stream: a micro-batch parses
the schema texts that no earlier batch brought, adds them under ``epoch=<id>``,
and joins its rows with the catalog.  Both the catalog's part and the batch's
output are folders of the batch's own, overwritten when the batch runs again, and
a batch reads only parts of earlier batches: a restart from the checkpoint, at
any point of a batch, gives the same tables.

A batch reads its files twice (schema texts, then rows) and the catalog's keys
once, and the parsed tables of its own schemas.  Null schemas and questions are
empty ones; a schema without tables keeps its text, as in ``prune_schemas``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera import fixed
from tessera.functions.prompts import eval_prompt
from tessera.functions.schema_text import prune_parsed, question_tokens
from tessera.operators.schema_ops import MODE, _parser


def _catalog_of(texts: DataFrame, mode: str) -> DataFrame:
    """schema_id, tables of distinct texts (schema_id, text)."""
    return texts.select("schema_id", _parser(mode)(F.col("text")).alias("tables"))


def read_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that finished batches wrote."""
    return spark.read.parquet(folder).drop("epoch")


def prune_stream(spark: SparkSession, source_dir: str, schema, out_dir: str, catalog_dir: str, checkpoint_dir: str,
                 min_tables: int = fixed.PRUNE_EVAL[0], max_cols: int = fixed.PRUNE_EVAL[1], mode: str = MODE,
                 files_per_batch: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Rows of a parquet folder stream with ``pruned_schema`` and ``prompt``
    (the evaluation prompt over the pruned schema), one ``epoch=<id>`` folder of
    ``out_dir`` per micro-batch; ``read_epochs`` reads them."""
    empty = _catalog_of(spark.createDataFrame([], "schema_id string, text string"), mode)
    empty.write.mode("ignore").parquet(f"{catalog_dir}/epoch=-1")
    stored = StructType([*empty.schema.fields, StructField("epoch", IntegerType())])

    def publish(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        earlier = session.read.schema(stored).parquet(catalog_dir).filter(F.col("epoch") < epoch).drop("epoch")
        keyed = batch.withColumn("_text", F.coalesce("db_schema", F.lit(""))).withColumn("schema_id", F.md5("_text"))
        texts = keyed.select("schema_id", F.col("_text").alias("text")).distinct()
        new = texts.join(earlier.select("schema_id").hint("merge"), "schema_id", "left_anti")
        part = f"{catalog_dir}/epoch={epoch}"
        _catalog_of(new, mode).write.mode("overwrite").parquet(part)
        catalog = earlier.unionByName(session.read.schema(empty.schema).parquet(part))
        pruned = keyed.join(catalog.hint("merge"), "schema_id", "left") \
            .withColumn("_tokens", question_tokens(F.col("question"))) \
            .withColumn("pruned_schema", prune_parsed(F.col("tables"), F.col("_tokens"), F.col("db_schema"), min_tables, max_cols,
                                                      documented=(mode == "documented")))
        out = pruned.withColumn("prompt", eval_prompt(F.coalesce("question", F.lit("")), F.col("pruned_schema")))
        out.select(*batch.columns, "pruned_schema", "prompt").write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    source = spark.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    w = source.parquet(source_dir).writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(publish)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
