"""Packing by power-of-two decomposition: documents are cut into pieces of binary lengths, one piece a sequence.

A document of n ids gives one piece of the longest length for each time it fits and one for each set bit of the
rest, longest first. Pieces of equal length form a bucket; every piece is a sequence of its own, so no sequence
crosses documents and none has padding. Within a bucket, sequences are numbered in document order, and the
buckets, longest first, follow each other in the numbering.

Defined cases: null text counts as empty (one piece holding the end id); rows that share a ``doc_id`` or repeat
are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brewlens.llm.common import pick, slices, stored
from brewlens.llm.tokenbin import ordered
from brewlens.llm.tokenizing import encoder, with_end

PIECES = (
    "part int, ordinal long, doc_id long, start long, length long, doc_tokens long, tokens binary"
)


def binary_lengths(n: int, most: int) -> list[int]:
    """``most`` as often as it fits, then the set bits of the rest, longest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, file: str, end_id: int = 1, most: int = 2048) -> DataFrame:
    """Pieces with their ids: doc_id, start, length, doc_tokens, sequence_id, offset, bucket, tokens (u32, little-endian).

    ``most`` must be a power of two. Tokenising runs once: the pieces are written to the shared folder, then
    numbered from one count per written range and bucket.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), dict.fromkeys((1 << b for b in range(most.bit_length())), 0)
        for batch in batches:
            for piece in slices(batch):
                ids, counts = with_end(*encoder(file).encode(piece.column("text")), end_id)
                doc, start, length, whole, ordinal = [], [], [], [], []
                for doc_id, n in zip(piece.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    at = 0
                    for size in binary_lengths(n, most):
                        doc.append(doc_id)
                        start.append(at)
                        length.append(size)
                        whole.append(n)
                        ordinal.append(seen[size])
                        seen[size] += 1
                        at += size
                ends = np.concatenate([[0], np.cumsum(length)]).astype("<i4") * 4
                tokens = pa.Array.from_buffers(
                    pa.binary(), len(length), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())]
                )
                numbers = [pa.array(x, pa.int64()) for x in (ordinal, doc, start, length, whole)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(doc), pa.int32()), *numbers, tokens],
                    ["part", "ordinal", "doc_id", "start", "length", "doc_tokens", "tokens"],
                )

    rows = stored(ordered(pick(docs, doc_id="doc_id", text="text")).mapInArrow(cut, PIECES), "pieces")
    # At most one row per range of the exchange and power of two, whatever the number of pieces.
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("here"))
    order = Window.orderBy(F.desc("length"), "part")
    first = counts.select("length", "part", (F.sum("here").over(order) - F.col("here")).alias("first"))
    # Broadcast: ranges times powers of two bound it. A plain join would send all pieces through an exchange.
    return rows.join(F.broadcast(first), ["length", "part"]).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("first") + F.col("ordinal")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"), "tokens",
    )
