"""Spelling variant grouping by asymmetric q-chunks (operator 11).

Two words are near if they differ by exactly one inserted, deleted or replaced
code point.  The longer one (of equally long ones, the smaller one) contributes
two disjoint chunks of q = half its length: its first q code points and its
last q.  One edit touches one of the two at most, so the other is a gram of the
shorter word.  The edit moves a chunk by at most one place, and by how much is
known: a chunk before the edit stays, one after it moves by the difference of
the lengths.  So of all positional grams of the shorter word only those at these
places can meet a chunk of a partner, and only they are made; positional grams
of a very long word would take the square of its length.  Chunks and grams meet
in an equality join on (partner's length, side, gram), and an exact edit
distance decides.  A pair that shares both chunks is counted on the first.

A chunk that very many words share (more than ``hot`` of them) is split: the
rest of the word is chunked in the same way, and the join takes one of those
chunks along.  So a family of words meets only in its nearer relatives.

Defined results: null and empty texts have no words; a null doc_id is written as
an empty string where occurrences are hashed; repeated rows count each; an empty
table gives an empty result.  Of words that tie as the largest near word the
smallest in code-point order is the form.  Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import materialize

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, least_length: int, one_in: int) -> DataFrame:
    """word: one row per letter run, lower-cased in A-Z; a run whose hash with
    its document is a multiple of ``one_in`` has lost a code point."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")) \
        .where(F.length("run") >= least_length) \
        .select("key", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word")) \
        .where(F.length("word") >= least_length)


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int = 199) -> DataFrame:
    """word, n of the words of at least ``least_length`` code points that occur
    at least ``least_count`` times.  Counts are combined before the shuffle."""
    return (occurrences(docs, least_length, one_in).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


def _part(word: Column, length: Column, q: Column, side: int) -> Column:
    """First (side 0) or last (side 1) ``q`` code points."""
    return F.substring(word, F.lit(1), q) if side == 0 else F.substring(word, length - q + 1, q)


def _rest(word: Column, length: Column, q: Column, side: int) -> Column:
    """What the part on ``side`` leaves of the word."""
    return F.substring(word, q + 1, length) if side == 0 else F.substring(word, F.lit(1), length - q)


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _keys(words: DataFrame, partner: list[int], split: bool) -> DataFrame:
    """word, n and a row per key: the length of the chunked word, the side, the
    chunk or gram, and with ``split`` a side and a chunk or gram of the rest.
    ``partner`` lists how much longer the chunked word is than this one."""
    word, length = F.col("word"), F.length("word")
    keys = []
    for more in partner:
        whole = length + more                   # the chunked word's length
        q = _half(whole)
        for side in (0, 1):
            key = [whole.alias("size"), F.lit(side).alias("side"), _part(word, length, q, side).alias("gram")]
            if not split:
                keys.append(F.struct(*key))
                continue
            rest, left, sub = _rest(word, length, q, side), length - q, _half(whole - q)
            keys += [F.struct(*key, F.lit(s).alias("sub_side"), _part(rest, left, sub, s).alias("sub_gram")) for s in (0, 1)]
    return words.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("word", "n", "k.*")


def near_pairs(words: DataFrame, hot: int = 2000) -> DataFrame:
    """a, a_n, b, b_n: each unordered pair of words one edit apart, once."""
    spark = words.sparkSession
    chunks, grams = _keys(words, [0], False), _keys(words, [0, 1], False)
    families = materialize(chunks.groupBy("size", "side", "gram").count().where(F.col("count") > hot).drop("count"), "hot-chunks")
    a, b = F.col("a"), F.col("b")
    q = _half(F.col("size"))
    one_edit = (F.col("size") > F.length(b)) | (a < b)
    fresh = (F.col("side") == 0) | (F.substring(a, F.lit(1), q) != F.substring(b, F.lit(1), q))

    def matched(chunked: DataFrame, other: DataFrame, on: list[str], first: Column) -> DataFrame:
        left = chunked.select(*on, F.col("word").alias("a"), F.col("n").alias("a_n"))
        right = other.select(*on, F.col("word").alias("b"), F.col("n").alias("b_n"))
        return left.join(right, on).where(one_edit & first & (F.levenshtein(a, b, 1) == 1)).select("a", "a_n", "b", "b_n")

    key = ["size", "side", "gram"]
    if families.isEmpty():
        return matched(chunks, grams, key, fresh)
    light = matched(chunks.join(families, key, "left_anti"), grams.join(families, key, "left_anti"), key, fresh)
    heavy = [_keys(words, more, True).join(families, key, "left_semi") for more in ([0], [0, 1])]
    left, whole = F.col("size") - q, F.col("size")
    sub = _half(left)
    ends = [_part(F.when(F.col("side") == 0, _rest(w, n, q, 0)).otherwise(_rest(w, n, q, 1)), n - q, sub, 0)
            for w, n in ((a, whole), (b, F.length(b)))]
    fresh_rest = (F.col("sub_side") == 0) | (ends[0] != ends[1])
    return light.unionByName(matched(*heavy, [*key, "sub_side", "sub_gram"], fresh & fresh_rest))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: where following ``form`` from each word ends.

    Every round doubles the steps that are followed.  A form occurs several
    times as often as its word, so a path has at most the logarithm of the
    largest count of steps, and there are no circles."""
    reach = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reach = materialize(reach.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                    F.col("further").isNotNull().alias("moved")), "roots")
        if reach.where("moved").isEmpty():
            return reach.select("word", "root")
        reach = reach.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, one_in: int = 199, times: int = 5,
                      hot: int = 2000) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = materialize(vocabulary(docs, least_length, least_count, one_in), "words")
    pairs = near_pairs(words, hot)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    largest = -F.col("best.less")
    enough = largest >= times * F.col("n")
    found = materialize(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"),
        F.when(enough, largest).alias("form_n")), "forms")
    roots = last_forms(found.where("form is not null"))
    return (found.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
