"""Token counts by the whole-token shortcut (operator 1).

A sentencepiece BPE model with an escaped space never merges across a word
start when no piece holds the space mark after another character, and never
across a line feed when no piece holds one.  ``prove`` checks both for the
given model, and then asks the library itself which vocabulary strings, taken
alone, encode to exactly one token.  Counting a text is then a split into
pre-tokens, a table lookup for those that are whole tokens, and the library's
merges for the remaining ones only (kept in a bounded table, since words
repeat).

Defined results: null and empty texts have 0 tokens; a text of any length is
counted whole; special strings inside a text are ordinary text, as is the
library's default; each input row gives one output row, repeated ids included;
an empty table gives an empty result.  Only ``doc_id`` and ``text`` are read,
so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import bounded_batches, tokenizer_file

MARK = "▁"          # the model's visible space
KEPT_WORDS = 400_000     # merged words a worker remembers before starting anew


@dataclass
class WholeTokens:
    """Pre-token counter of one model, proven for that model when built."""

    model: str
    whole: dict[str, int] = field(default_factory=dict)
    merged: dict[str, int] = field(default_factory=dict)
    separable: bool = False

    def __post_init__(self) -> None:
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(self.model))
        self.prove()

    def prove(self) -> None:
        """Establish, from the vocabulary, that pre-tokens are independent and
        which of them are whole tokens."""
        lib = self.library
        ids = [i for i in range(lib.get_piece_size())
               if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i))]
        pieces = {i: lib.id_to_piece(i) for i in ids}
        self.separable = (
            not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces.values())
            and lib.encode("a", out_type=str)[0].startswith(MARK)      # a mark is put before the text
            and lib.encode("  a", out_type=str) != lib.encode("a", out_type=str))  # spaces are kept
        if not self.separable:
            return
        words = {p[1:]: i for i, p in pieces.items() if p.startswith(MARK) and MARK not in p[1:] and len(p) > 1}
        alone = lib.encode(list(words), num_threads=1)
        self.whole = {w: 1 for (w, i), got in zip(words.items(), alone, strict=True) if got == [i]}

    def count(self, texts: list[str]) -> list[int]:
        if not self.separable:
            return [len(x) for x in self.library.encode(texts, num_threads=1)]
        # A line feed starts a pre-token of its own; it is no space, so the
        # mark that the library would put before it is taken off again.
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        plain = [i for i, words in enumerate(split) if "" not in words and MARK not in texts[i]]
        new = set().union(*(split[i] for i in plain)).difference(self.merged, self.whole)
        if len(self.merged) + len(new) > KEPT_WORDS:
            self.merged.clear()
            new = set().union(*(split[i] for i in plain)).difference(self.whole)
        if not self.merged:
            self.merged.update(self.whole)
        merge = list(new)
        for w, got in zip(merge, self.library.encode(merge, num_threads=1), strict=True):
            self.merged[w] = len(got) - w.startswith("\n")
        get = self.merged.__getitem__
        out = [0] * len(texts)
        for i in plain:
            out[i] = sum(map(get, split[i]))
        odd = sorted(set(range(len(texts))).difference(plain))       # runs of spaces, empty texts, a written mark
        for i, got in zip(odd, self.library.encode([texts[i] for i in odd], num_threads=1), strict=True):
            out[i] = len(got)
        return out


def token_count(text: Column, model: str) -> Column:
    """Number of tokens of ``text`` (long), without begin and end tokens."""
    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = WholeTokens(model)
        for batch in batches:
            found: list[int] = []
            for at in range(0, len(batch), 512):
                found += counter.count(batch[at:at + 512].to_pylist())
            yield pa.array(found, pa.int64())

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    bounded_batches(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                        token_count(F.col("text"), model).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
