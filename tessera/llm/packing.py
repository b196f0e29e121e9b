"""Cost-balanced packing of tokenised documents into sequences (operator 5).

The tokens of a document are its ids and one end id.  Its attention cost, when
it attends only to itself, is ``linear * n + quadratic * n * n``.  Rows are
packed in groups of about ``group_tokens`` tokens as a task reads them: whole
sequences are cut off each long document first, and the rests are taken in
descending order, each going to the cheapest sequence that still has room for
it.  There are only as many sequences as the group's tokens need, so a rest
that fits nowhere is cut to fill the roomiest sequence and its remainder tried
again: a group wastes less than one sequence.  Nothing is shuffled, and a task
holds one group (or one document, where that is larger) at a time.

Defined results: null and empty texts are the end id alone; every input row is
packed, repeated ids included (they then share doc_id and differ in sequence
and offset); ties in length go by the order of reading; an empty table gives an
empty result.  Only ``doc_id`` and ``text`` are read.  A task that runs again
gives the same sequences, because a split is read in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from tessera.llm.common import bounded_batches, text_or_empty

KEPT = 300_000          # pre-tokens in each generation that a worker remembers
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, `offset` long, ids binary"


def place(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece.

    ``lengths`` are the documents' token counts, each at least 1.
    """
    import heapq

    import numpy as np
    pieces, rests, sequences = [], [], 0
    for doc, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((doc, k * capacity, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rests.append((-(n % capacity), doc, full * capacity))
    bins = -(-sum(-r[0] for r in rests) // capacity)
    cost, room = np.zeros(bins), np.full(bins, capacity, dtype=np.int64)
    heapq.heapify(rests)
    while rests:
        size, doc, start = heapq.heappop(rests)
        size = -size
        fits = np.flatnonzero(room >= size)
        if len(fits):
            at, take = int(fits[np.argmin(cost[fits])]), size
        else:
            at = int(np.argmax(room))
            take = int(room[at])
            heapq.heappush(rests, (take - size, doc, start + take))
        pieces.append((doc, start, take, sequences + at, int(capacity - room[at])))
        cost[at] += linear * take + quadratic * take * take
        room[at] -= take
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", rule: str = "bytes", end_id: int = 1,
                   capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048,
                   group_tokens: int = 1 << 21) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids (binary, little-endian unsigned 32-bit)."""

    bounded_batches(docs)

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm.pretokens import worker_encoder
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
                           + [("ids", pa.binary())])
        encoder, end = worker_encoder(tokenizer, rule, KEPT), end_id.to_bytes(4, "little")
        next_sequence = TaskContext.get().partitionId() << 33
        names: list = []
        ids: list[bytes] = []
        held = 0

        def packed():
            nonlocal next_sequence, held
            sizes = [len(x) // 4 for x in ids]
            rows = place(sizes, capacity, linear, quadratic)
            doc, start, length, seq, offset = zip(*rows, strict=True)
            out = pa.record_batch([
                pa.array([names[d] for d in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array([sizes[d] for d in doc], pa.int64()), pa.array([next_sequence + s for s in seq], pa.int64()),
                pa.array(offset, pa.int64()),
                pa.array([ids[d][4 * s:4 * (s + n)] for d, s, n in zip(doc, start, length, strict=True)], pa.binary()),
            ], schema=schema)
            next_sequence += max(seq) + 1
            names.clear()
            ids.clear()
            held = 0
            return out

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = encoder.encode(part.column(1).to_pylist())
                for name, x in zip(part.column(0).to_pylist(), found, strict=True):
                    names.append(name)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= group_tokens:
                        yield packed()
        if ids:
            yield packed()

    return docs.select(docs["doc_id"].cast("long"), text_or_empty().alias("text")).mapInArrow(pack, PIECES)
