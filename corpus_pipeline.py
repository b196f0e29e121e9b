"""Corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``.  ``run`` writes every stage's rows as
Parquet and rereads them for the next one.  Stages that learn take their labels
from the ``labels`` table (language ID: from the documents' own ``lang``) and
see no document that an earlier stage dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import language, mixing, packing, quality, simhash
from tessera.llm.common import materialize, table

#: A document must be predicted good by the quality classifier.
LEAST_QUALITY = 0.5
#: A document whose likeliest language has less probability than this is
#: dropped, as is one without a letter.  Even odds of four languages are 0.25.
LEAST_LANGUAGE = 0.3
#: Shares of the tokens of the mixed corpus.  Poor documents have gone before;
#: what is left of them in posteriors must not be repeated to fill a share.
TARGETS = {"good": 0.965, "poor": 0.005, "toxic": 0.03}

#: No SQL can learn the models of the first stages; the test runs the same
#: stages over brute-force operators.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier predicts to be poor."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(F.col("text"), model) >= LEAST_QUALITY)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no recognisable language."""
    found = language.language_of(F.col("text"), language.fit_language(docs))
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= LEAST_LANGUAGE))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group."""
    return simhash.keep_first(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that domain shares meet the targets."""
    return mixing.mix_documents(docs, mixing.domain_labels(table(spark, sf_dir, "labels")), TARGETS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack: one row per piece of a document in a sequence."""
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset",
                         F.crc32("ids").alias("ids_crc32"), "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing_to_targets),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
