"""Token ids in byte-aligned variable-length coding (operator 6).

Ids are replaced by their rank in descending frequency over all documents, so
frequent ids take one byte.  A value takes 1 to 4 bytes; its length minus one
lies in two bits of a separate control stream, four values to a control byte.
Decoding looks up each control byte in a 256-row table of lengths, which gives
every value's place in the data stream at once.

A token file is a folder of two Parquet tables: ``vocabulary`` (rank, id,
occurrences) and ``blocks``, in ascending doc_id order over (part, block), each
row holding whole documents: doc_ids, lengths (ids of each), first (ids of the
part before the block), n_ids, and the documents' control and data bytes one
after the other (each document starts a control byte of its own).  A part is a
range of document ids; parts hold about equally many documents.

Each text is tokenised once; the ids wait, two bytes each where the vocabulary
allows it, in a table that is deleted when the file is written.  The only
shuffle moves documents already in their final coding.

Defined results: null and empty texts are the end id alone; repeated ids keep
one entry per row, in the order of their coding; null ids come last; an
empty table gives an empty file and no rows.  Only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.llm.common import bounded_batches, drop_table, id_marks, materialize, range_of, text_or_empty, tokenizer_file
from tessera.session import scratch_path

BLOCKS = ("part long, block long, first long, n_ids long, doc_ids array<long>, lengths array<long>, "
          "control binary, data binary")
BLOCK_IDS = 1 << 16
KEPT = 800_000          # pre-tokens in each generation that a worker remembers


# --- the coding -----------------------------------------------------------

def _lengths_table() -> np.ndarray:
    """Lengths of the four values of each control byte."""
    control = np.arange(256)
    return np.stack([(control >> (2 * k)) & 3 for k in range(4)], axis=1).astype(np.uint8) + 1


LENGTHS = _lengths_table()


def encode_documents(values: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, bytes, np.ndarray]:
    """(control, ends, data, ends) of documents of ``lengths`` unsigned 32-bit
    values each, one after the other; a document begins a control byte."""
    n = len(values)
    size = (values > 0xFF).astype(np.uint8)
    width = 2
    if n and values.max() > 0xFFFF:
        size += values > 0xFFFF
        size += values > 0xFFFFFF
        width = 4
    ends, padded = np.cumsum(lengths), -(-lengths // 4)
    begin = np.cumsum(padded) - padded
    codes = np.zeros(4 * int(padded.sum()), dtype=np.uint8)
    codes[np.arange(n) + np.repeat(4 * begin - ends + lengths, lengths)] = size
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    octets = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    data = octets[np.arange(width) <= size[:, None]]
    reached = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[ends] + ends       # bytes up to each document's end
    return control.tobytes(), np.append(0, np.cumsum(padded)), data.tobytes(), np.append(0, reached)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of the values of one document."""
    control, _, data, _ = encode_documents(values, np.array([len(values)]))
    return control, data


def decode_values(control: bytes, data: bytes, lengths: list[int]) -> np.ndarray:
    """The values of a block of documents with the given numbers of values."""
    lengths = np.asarray(lengths, dtype=np.int64)
    padded = -(-lengths // 4) * 4
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)
    ends = np.cumsum(padded)
    unused = [np.arange(e - p + n, e) for e, p, n in zip(ends, padded, lengths, strict=True) if p > n]
    if unused:
        size = np.delete(size, np.concatenate(unused))
    width = 4 if len(size) and size.max() > 2 else 2
    octets = np.zeros((len(size), width), dtype=np.uint8)
    octets[np.arange(width) < size[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return octets.view(f"<u{width}").reshape(-1)


# --- Spark jobs -----------------------------------------------------------

def token_ids(docs: DataFrame, tokenizer: str, rule: str, end_id: int, id_type: str) -> DataFrame:
    """(doc_id, ids): every document's ids and the end id, as ``id_type``."""

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.pretokens import binary_slices, text_slices, worker_encoder
        encoder, width = worker_encoder(tokenizer, rule, KEPT), np.dtype(id_type).itemsize
        for batch in batches:
            for at, rows in text_slices(batch.column(1)):
                part = batch.slice(at, rows)
                ids, lengths = encoder.encode_column(part.column(1), end_id)
                ends = np.append(0, np.cumsum(lengths))
                yield pa.record_batch([part.column(0), binary_slices(ids.astype(id_type).tobytes(), ends * width)], names=["doc_id", "ids"])

    return (docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
            .mapInArrow(encode, "doc_id long, ids binary"))


def all_values(column, id_type: str) -> np.ndarray:
    """The values of all rows of an Arrow binary column, one after the other."""
    if not len(column):
        return np.zeros(0, dtype=id_type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[1]].view(id_type)


def frequency_ranks(tokens: DataFrame, id_type: str) -> DataFrame:
    """(rank, id, occurrences): all ids by descending count, then by id.  As
    many rows as the vocabulary has ids in use, whatever the corpus size."""

    def tally(batches: Iterator) -> Iterator:
        import pyarrow as pa
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            seen = np.bincount(all_values(batch.column(0), id_type))
            if len(seen) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(seen) - len(counts), dtype=np.int64)])
            counts[:len(seen)] += seen
        ids = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(counts[ids], pa.int64())], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("occurrences"))
    order = W.orderBy(F.col("occurrences").desc(), "id")
    return counts.select((F.row_number().over(order) - 1).cast("long").alias("rank"), "id", "occurrences")


def write_token_file(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", rule: str = "words",
                     end_id: int = 2) -> None:
    """Encode every document and write the token file at ``path`` (a folder in
    storage that all executors share)."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    bounded_batches(docs)
    largest = max(Tokenizer.from_file(tokenizer_file(tokenizer)).get_vocab_size() - 1, end_id)
    id_type = "<u2" if largest < 1 << 16 else "<u4"
    tokens = materialize(token_ids(docs, tokenizer, rule, end_id, id_type), "token-ids")
    frequency_ranks(tokens, id_type).write.parquet(f"{path}/vocabulary")
    # At most as many rows as the tokenizer has ids.
    by_rank = spark.read.parquet(f"{path}/vocabulary").toPandas()
    rank_of = np.zeros(largest + 1, dtype="<u4")
    rank_of[by_rank["id"].to_numpy()] = by_rank["rank"].to_numpy()
    ranks = spark.sparkContext.broadcast(rank_of)

    def code(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        from tessera.llm.pretokens import binary_slices, worker_encoder
        worker_encoder.cache_clear()        # all ids are known; a worker's pre-tokens take some 200 MB
        width = np.dtype(id_type).itemsize
        for batch in batches:
            for at in range(0, len(batch), 128):
                own = batch.slice(at, 128)
                lengths = pc.binary_length(own.column(2)).to_numpy().astype(np.int64) // width
                control, control_ends, data, data_ends = encode_documents(ranks.value[all_values(own.column(2), id_type)], lengths)
                yield pa.record_batch([own.column(0), own.column(1), pa.array(lengths, pa.int64()),
                                       binary_slices(control, control_ends), binary_slices(data, data_ends)],
                                      names=["part", "doc_id", "length", "control", "data"])

    def block(batches: Iterator) -> Iterator:
        import pyarrow as pa
        schema = pa.schema([(c, pa.int64()) for c in ("part", "block", "first", "n_ids")]
                           + [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                              ("control", pa.binary()), ("data", pa.binary())])
        rows: list = []         # slices of batches, of whole documents
        part, number, first, held = None, 0, 0, 0

        def packed():
            nonlocal rows, number, first, held
            doc_ids, lengths = (pa.concat_arrays([r.column(k) for r in rows]) for k in (1, 2))
            streams = [b"".join(all_values(r.column(k), np.uint8).tobytes() for r in rows) for k in (3, 4)]
            ends = pa.array([0, len(doc_ids)], pa.int32())
            row = [pa.array([x], pa.int64()) for x in (part, number, first, held)]
            row += [pa.ListArray.from_arrays(ends, x) for x in (doc_ids, lengths)] + [pa.array([x], pa.binary()) for x in streams]
            rows, number, first, held = [], number + 1, first + held, 0
            return pa.RecordBatch.from_arrays(row, schema=schema)

        for batch in batches:
            parts, begin = batch.column(0).to_numpy(), 0
            for at, (p, n) in enumerate(zip(parts.tolist(), batch.column(2).to_pylist(), strict=True)):
                if held and (p != part or held >= BLOCK_IDS):
                    if at > begin:
                        rows.append(batch.slice(begin, at - begin))
                    begin = at
                    yield packed()
                if p != part:
                    part, number, first = p, 0, 0
                held += n
            if len(batch) > begin:
                rows.append(batch.slice(begin))
        if rows:
            yield packed()

    marks = id_marks(tokens, "doc_id", 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    (tokens.select(range_of("doc_id", marks).cast("long").alias("part"), "doc_id", "ids")
     .mapInArrow(code, "part long, doc_id long, length long, control binary, data binary")
     .repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "control", "data")
     .mapInArrow(block, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks"))
    drop_table(tokens)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a token file; ids is
    binary, little-endian unsigned 32-bit, and start counts the ids of all
    documents before it."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row per part of the file, and at most one per id of the vocabulary.
    sizes = blocks.groupBy("part").agg(F.max(F.col("first") + F.col("n_ids")).alias("n")).orderBy("part").toPandas()
    base = dict(zip(sizes["part"], np.concatenate([[0], np.cumsum(sizes["n"])]), strict=False))
    vocabulary = spark.read.schema("rank long, id long, occurrences long").parquet(f"{path}/vocabulary")
    id_of = vocabulary.orderBy("rank").select("id").toPandas()["id"].to_numpy().astype("<u4")
    shared = spark.sparkContext.broadcast((base, id_of))

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.pretokens import binary_slices
        base, id_of = shared.value
        for batch in batches:
            for at in range(len(batch)):
                part, first, control, data = (batch.column(k)[at] for k in (0, 1, 5, 6))
                doc_ids, lengths = (batch.column(k)[at].values for k in (3, 4))
                n = lengths.to_numpy()
                ids = id_of[decode_values(control.as_buffer(), data.as_buffer(), n)]
                ends = np.append(0, np.cumsum(n))
                yield pa.record_batch([
                    doc_ids, pa.array(base[part.as_py()] + first.as_py() + ends[:-1], pa.int64()), lengths,
                    binary_slices(ids.tobytes(), 4 * ends)], names=["doc_id", "start", "n_tokens", "ids"])

    return (blocks.select("part", "first", "n_ids", "doc_ids", "lengths", "control", "data")
            .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary"))


def token_file_path(spark: SparkSession) -> str:
    """A fresh place for a token file in the session's shared folder."""
    return scratch_path(spark, "token-file")
