"""Structured Streaming runs of the per-row operators.

Classification, SQL features, scoring and prompt rendering are stateless
column expressions, so the batch code applies unchanged to ``readStream``.
Class counts run as a streaming aggregate; every micro-batch writes its full
result to a folder of its own (``epoch=<id>``, the same one when the batch is
run again), so readers always find the last complete one.  Both queries checkpoint to the given folder
(under the cluster's ``spark.checkpoint.dir``), so a restarted query resumes
where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.classify import classify_query_type


def classify_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                    available_now: bool = True) -> StreamingQuery:
    """Append classified rows from a parquet folder stream to a parquet sink."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    out = src.withColumn("query_type", classify_query_type(F.col("SQL")))
    w = out.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink_dir)


def class_counts_stream(spark: SparkSession, source_dir: str, schema, table_dir: str, checkpoint_dir: str,
                        available_now: bool = True) -> StreamingQuery:
    """Running rows-per-class counts; each micro-batch adds a version of the full result."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    counts = src.groupBy(classify_query_type(F.col("SQL")).alias("query_type")).agg(F.count(F.lit(1)).alias("n"))

    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_dir}/epoch={epoch}")

    w = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_dir).foreachBatch(publish)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def latest(spark: SparkSession, table_dir: str) -> DataFrame:
    """The last version that ``class_counts_stream`` wrote."""
    versions = spark.read.parquet(table_dir)
    last = versions.agg(F.max("epoch")).first()[0]      # one row; partition values only
    return versions.filter(F.col("epoch") == last).drop("epoch")
