"""Token-id output: each document compressed alone with one shared zstandard dictionary.

Files are Parquet blocks of about a megabyte, written by Spark's own committer, so a lost executor or a repeated
task leaves no half-written file and any store Spark can write will do. A block holds the compressed documents
one behind the other, the hash of the dictionary, and an index of (doc_id, offset, bytes, tokens): one short
document is read by pruning blocks on ``first_doc_id`` and ``last_doc_id``, slicing and expanding it alone.
The dictionary lies next to the blocks. Ids are stored in two bytes where the vocabulary fits, else in four.

Defined cases: null text counts as empty and holds the end id only; documents lie in ascending ``doc_id`` order,
null first, rows with equal ``doc_id`` in order of their text's hash; repeated rows are all kept; an empty table
gives no blocks; a text of any length is one document in one block; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brewlens.llm.common import partitions, pick, slices
from brewlens.llm.tokenizing import encoder, with_end

BLOCKS = (
    "part int, block long, first_doc_id long, last_doc_id long, part_start long, n_tokens long, id_bytes int,"
    " dict_hash string, payload binary,"
    " index array<struct<doc_id: long, offset: long, n_bytes: long, n_tokens: long>>"
)


def ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents dealt out in ranges of ``doc_id`` and sorted; ranges also split rows that share an id."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("tie", F.xxhash64("text"))
    return (
        rows.repartitionByRange(partitions(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    )


def train_dictionary(
    docs: DataFrame, file: str, end_id: int, id_bytes: int, sample: int = 1000, size: int = 64 << 10
) -> bytes:
    """A dictionary from a seeded draw of at most ``sample`` documents (32 KiB of each), made in one task."""
    dtype = f"<u{id_bytes}"

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples: list[bytes] = []
        for batch in batches:
            for part in slices(batch):
                ids, counts = with_end(*encoder(file).encode(part.column("text")), end_id)
                for one in np.split(ids, np.cumsum(counts)[:-1]):
                    samples.append(one[: (32 << 10) // id_bytes].astype(dtype).tobytes())
        try:
            made = zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on: their own bytes serve
            made = b"".join(samples)[-size:]
        yield pa.RecordBatch.from_pydict({"made": pa.array([made], pa.binary())})

    # The count comes from file footers; about ``sample`` rows from all over the table are drawn, whatever its size.
    share = min(1.0, sample / max(1, docs.count()))
    few = pick(docs, text="text").sample(share, seed=7)
    rows = few.coalesce(1).mapInArrow(train, "made binary").collect()
    return bytes(rows[0]["made"]) if rows else b""


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def write_tokens(
    docs: DataFrame, out: str, file: str, end_id: int = 1, vocabulary: int = 49_408, block_bytes: int = 1 << 20
) -> None:
    """Write ``out/dictionary`` and ``out/blocks``."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id="doc_id", text="text")
    id_bytes = 2 if vocabulary <= 1 << 16 else 4
    content = train_dictionary(docs, file, end_id, id_bytes)
    digest = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(digest, bytearray(content))], "dict_hash string, content binary").coalesce(
        1
    ).write.parquet(f"{out}/dictionary")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _dictionary(content)
        squeeze = zstandard.ZstdCompressor(level=3, **({"dict_data": made} if made else {}))
        part, number, total = TaskContext.get().partitionId(), 0, 0
        names = [f.name for f in schema]
        frames: list[bytes] = []
        index: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, total, held
            n = sum(x[3] for x in index)
            fields = ("doc_id", "offset", "n_bytes", "n_tokens")
            row = [
                part, number, index[0][0], index[-1][0], total, n, id_bytes, digest, b"".join(frames),
                [dict(zip(fields, x, strict=True)) for x in index],
            ]
            number, total, held = number + 1, total + n, 0
            frames.clear()
            index.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], names
            )

        for batch in batches:
            for piece in slices(batch):
                ids, counts = with_end(*encoder(file).encode(piece.column("text")), end_id)
                raw, at = ids.astype(f"<u{id_bytes}").tobytes(), 0
                for doc_id, n in zip(piece.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    frame = squeeze.compress(raw[at : at + n * id_bytes])
                    at += n * id_bytes
                    frames.append(frame)
                    index.append((doc_id, held, len(frame), n))
                    held += len(frame)
                    if held >= block_bytes:
                        yield flush()
        if index:
            yield flush()

    entry = pa.struct([(n, pa.int64()) for n in ("doc_id", "offset", "n_bytes", "n_tokens")])
    schema = pa.schema([
        ("part", pa.int32()), ("block", pa.int64()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()),
        ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32()), ("dict_hash", pa.string()),
        ("payload", pa.binary()), ("index", pa.list_(entry)),
    ])
    ordered(docs).mapInArrow(block, BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")


def read_tokens(spark: SparkSession, out: str, doc_id: int | None = None) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u32).

    With ``doc_id`` only the blocks that can hold it are read, and only its own bytes are expanded.
    """
    kept = spark.read.parquet(f"{out}/dictionary").first()
    content, expected = bytes(kept["content"]), kept["dict_hash"]
    if hashlib.sha256(content).hexdigest() != expected:
        raise ValueError("the dictionary's content does not have its hash")
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    # One row per written range: their number is the exchange's, not the data's.
    ends = blocks.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = ends.select(
        "part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("before")
    )
    if doc_id is not None:
        blocks = blocks.where((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id))
    rows = blocks.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("part_start"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _dictionary(content)
        grow = zstandard.ZstdDecompressor(**({"dict_data": made} if made else {}))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != expected:
                    raise ValueError("a block was written with another dictionary")
                start, docs, held = row["start"], [], 0
                for x in row["index"]:
                    if doc_id is None or x["doc_id"] == doc_id:
                        frame = row["payload"][x["offset"] : x["offset"] + x["n_bytes"]]
                        ids = np.frombuffer(grow.decompress(frame), dtype=f"<u{row['id_bytes']}").astype("<u4")
                        docs.append((x["doc_id"], start, x["n_tokens"], ids.tobytes()))
                        held += ids.nbytes
                    start += x["n_tokens"]
                    if held >= 4 << 20:
                        yield out_batch(docs)
                        docs, held = [], 0
                if docs:
                    yield out_batch(docs)

    def out_batch(docs: list[tuple]) -> pa.RecordBatch:
        kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()))
        return pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in docs], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds]
        )

    few = rows.select("start", "id_bytes", "dict_hash", "payload", "index")
    return few.mapInArrow(expand, "doc_id long, start long, n_tokens long, ids binary")
