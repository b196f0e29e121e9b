"""Document fingerprints by consistent weighted sampling (operator 7).

A text's terms are its words, weighted by how often they occur.  For sample k
and a term, a hash of both fixes two Gamma(2, 1) values r and c and a uniform
value b; with weight w, the term's level is t = floor(ln w / r + b) and its
value ln a = ln c - r (t - b + 1).  The sample is the (term, level) of the
smallest value.  Two texts agree in a sample with the probability of their
generalised Jaccard similarity: the sum over terms of the smaller weight, over
that of the larger one.

All of it is DataFrame functions.  A value and its (term, level) hash share one
long, so a sample is one ``min`` and a text one aggregate of ``samples`` of
them; the Gamma values come from a table of quantiles.  Terms are counted
inside their row (sort the hashed words, find where a new one starts), so no
row per term is ever shuffled.

The next document's text is found by one shuffle: ids are cut into ranges at
approximate quantiles, the first document of each range is also put at the end
of the range before it, and a window within each range looks one row ahead.
Everything after that (edited texts, fingerprints, likeness) reuses the same
partitioning.

Defined results: a null text is an empty one; a text without words has a
fingerprint of zeros, alike (1.0) only with others of its kind; rows with a
null id come last, in the order of their texts; repeated ids each keep their
row, in the order of their texts; the only document is its own next one; an
empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.llm.common import id_marks, range_of

QUANTILES = 2048
LOW = (1 << 32) - 1


def gamma_quantiles(n: int = QUANTILES) -> np.ndarray:
    """Mid-quantiles of Gamma(2, 1), whose distribution function is
    1 - (1 + x) exp(-x), by bisection."""
    wanted = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(80):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < wanted
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def constant_array(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def sample_value(k: int, term: Column, log_weight: Column, r_table: Column, c_table: Column) -> Column:
    """The long that sample ``k`` takes the smallest of: ln a in the upper 32
    bits, the hash of (term, level) in the lower ones."""
    h = F.xxhash64(term, F.lit(k))
    bits = (QUANTILES - 1).bit_length()
    r = F.get(r_table, h.bitwiseAND(F.lit(QUANTILES - 1)).cast("int"))
    log_c = F.get(c_table, F.shiftrightunsigned(h, bits).bitwiseAND(F.lit(QUANTILES - 1)).cast("int"))
    b = F.shiftrightunsigned(h, 40).cast("double") * (1.0 / (1 << 24))
    level = F.floor(log_weight / r + b)
    value = log_c - r * (level.cast("double") - b + 1.0)
    own = h.bitwiseXOR(level).bitwiseAND(F.lit(LOW))
    return F.shiftleft(((value + 64.0) * float(1 << 24)).cast("long"), 32).bitwiseOR(own)


def counted_terms(text: str) -> tuple[Column, Column]:
    """Sorted word hashes of a text column, and the places where a word that
    differs from the one before starts."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))
    return hashes, F.filter(F.sequence(F.lit(0), F.size("_hashes") - 1),
                            lambda i: (i == 0) | (F.get("_hashes", i) != F.get("_hashes", i - 1)))


def signatures(texts: DataFrame, keys: list[str], text: str, samples: int) -> DataFrame:
    """``keys`` and sig (array of ``samples`` longs of 32 bits) of each text.

    ``keys`` identify a row.  No shuffle happens if ``texts`` is partitioned by
    some of them."""
    hashes, starts = counted_terms(text)
    rows = (texts.withColumn("_hashes", hashes)
            .withColumn("_starts", F.when(F.size("_hashes") > 0, starts))
            .select(*keys, "_hashes", "_starts", F.posexplode_outer("_starts").alias("_at", "_start"))
            .select(*keys, F.get("_hashes", F.col("_start")).alias("_term"),
                    F.ln((F.coalesce(F.get("_starts", F.col("_at") + 1), F.size("_hashes")) - F.col("_start")).cast("double"))
                    .alias("_log_weight")))
    # The tables stay columns (no constant, because of the condition): as
    # constants they would be written into each sample's expression anew.
    always = F.col("_log_weight").isNull() | (F.col("_log_weight") >= 0)
    rows = rows.withColumns({"_r": F.when(always, constant_array(gamma_quantiles())),
                             "_c": F.when(always, constant_array(np.log(gamma_quantiles())))})
    found = rows.groupBy(*keys).agg(*(
        F.min(sample_value(k, F.col("_term"), F.col("_log_weight"), F.col("_r"), F.col("_c"))).alias(f"_s{k}")
        for k in range(samples)))
    sig = F.array(*(F.coalesce(F.col(f"_s{k}").bitwiseAND(F.lit(LOW)), F.lit(0).cast("long")) for k in range(samples)))
    return found.select(*keys, sig.alias("sig"))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of samples in which two signatures agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(samples))


def hex_signature(sig: Column) -> Column:
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` (doc_id, text) with the range b of each id and late: the first
    rows of each range come once more, late, at the end of the range before
    (those of the first range at the end of the last)."""
    marks = id_marks(docs, "doc_id", ranges)
    if not marks:
        return docs.withColumns({"b": F.lit(0), "late": F.lit(0)})
    is_first = F.coalesce(F.get(F.lit(marks), F.col("b")) == F.col("doc_id"), F.lit(False))
    before = F.when(F.col("b") == 0, len(marks) - 1).otherwise(F.col("b") - 1)
    spots = F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("late")),
                    F.when(is_first, F.struct(before.alias("b"), F.lit(1).alias("late"))))
    return (docs.withColumn("b", range_of("doc_id", marks))
            .select("doc_id", "text", F.explode(F.array_compact(spots)).alias("spot"))
            .select("doc_id", "text", "spot.b", "spot.late"))


def fingerprint_edits(docs: DataFrame, samples: int = 64) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every document.  The edited text is the document
    with the last half of its code points replaced by the first as many of the
    next document's."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    by_id = W.partitionBy("b").orderBy("late", F.col("doc_id").asc_nulls_last(), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    ordered = (in_ranges(own, 4 * partitions)
               .select("*", F.row_number().over(by_id).alias("row"),
                       F.coalesce(F.lead("text").over(by_id), F.first("text").over(by_id)).alias("next"))
               .withColumn("n_chars", F.length("text"))
               .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half),
                                              F.substring("next", F.lit(1), half))))
    both = F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("text")),
                   F.when(F.col("late") == 0, F.struct(F.lit(1).alias("version"), F.col("edited").alias("text"))))
    keys = ["b", "late", "doc_id", "row", "n_chars", "sha", "version"]
    versions = (ordered.select("b", "late", "doc_id", "row", "n_chars", F.sha2(F.col("edited"), 256).alias("sha"),
                               F.explode(F.array_compact(both)).alias("v"))
                .select(*keys[:-1], "v.version", "v.text"))
    found = signatures(versions, keys, "text", samples)
    along = W.partitionBy("b").orderBy("row", "version")
    other, following = F.lead("sig", 1).over(along), F.coalesce(F.lead("sig", 2).over(along), F.first("sig").over(along))
    return (found.select("*", other.alias("edited_sig"), following.alias("next_sig"))
            .where("version = 0 and late = 0")
            .select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"),
                    hex_signature(F.col("sig")).alias("fingerprint"),
                    hex_signature(F.col("edited_sig")).alias("edited_fingerprint"),
                    likeness(F.col("sig"), F.col("edited_sig"), samples).alias("near_edited"),
                    likeness(F.col("sig"), F.col("next_sig"), samples).alias("near_next")))
