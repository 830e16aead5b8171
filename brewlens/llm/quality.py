"""Quality rules: counts of words and symbols, and a hashed n-gram likelihood ratio.

Byte four-grams of every text are counted each, and then hashed into buckets, at least twice as many as there are
different four-grams, so that the model grows with the input. Two multinomials are counted over them:
one over trusted documents (label quality 1; a bounded number of them, see ``TRUSTED``), one over all documents. A document's score is the mean over its
four-grams of log p(trusted) - log p(all); it is kept if the score reaches a fixed threshold. The threshold is
the same for every document and every corpus: no ranking, no random draw.

Defined cases: null and empty text have no words, so the base rule drops them; a text under four bytes with words
scores 0; with no trusted document every score is 0 and the base rule alone decides; rows that share a ``doc_id``
are judged each; labels with null or several values for one id count as trusted only if all of them are 1; null
ids are never trusted; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brewlens.llm.common import packed, pick, slices, stored

#: Hash buckets of the model at least.
BUCKETS = 1 << 16
#: Different four-grams that a task holds before it sends their counts.
HELD = 1 << 20
#: Trusted documents the target is counted over at most: those with the smallest hashed ids. This bounds what is broadcast.
TRUSTED = 20_000
#: Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3
#: Mean log-likelihood ratio per four-gram from which a document is kept.
THRESHOLD = -1.0


def codes(data: bytes) -> np.ndarray:
    """Each byte four-gram, mixed: the mixing maps no two four-grams to one value, and its upper bits are the bucket."""
    b = np.frombuffer(data, dtype=np.uint8)
    if len(b) < 4:
        return np.zeros(0, dtype=np.uint32)
    b = b.astype(np.uint32)
    packed = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return packed * np.uint32(2654435761)


def grams(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each byte four-gram, of a power of two of buckets."""
    return (codes(data).astype(np.int64) * buckets) >> 32


def width(different: int) -> int:
    """Buckets for so many different four-grams: the power of two that leaves half of them empty, ``BUCKETS`` at least."""
    return min(max(BUCKETS, 1 << max(2 * different - 1, 0).bit_length()), 1 << 32)


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    rows = pick(labels, doc_id="doc_id", quality="quality")
    return (
        rows.where("doc_id is not null").groupBy("doc_id")
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("least"), F.max("quality").alias("most"))
        .where("least = 1 and most = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        .select("doc_id", F.lit(True).alias("trusted"))
    )


def fit(docs: DataFrame, labels: DataFrame, buckets: int | None = None) -> np.ndarray:
    """log p(trusted) - log p(all) of each bucket, counted over all documents.

    Each task adds its own counts up first; the counts of all four-grams are a table. Without ``buckets`` (a power of
    two) its rows decide how many there are.
    """
    rows = pick(docs, doc_id="doc_id", text="text").where("text is not null").join(
        F.broadcast(trusted_ids(labels)), "doc_id", "left"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(held[0].astype(np.int64)), *map(pa.array, held[1:])], ["gram", "everywhere", "trusted"]
            )

        for batch in batches:
            for part in slices(batch):
                chosen = part.column("trusted").fill_null(False).to_pylist()
                made = [codes(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                for at, which in ((1, made), (2, [m for m, yes in zip(made, chosen, strict=True) if yes])):
                    if which:
                        found, times = np.unique(np.concatenate(which), return_counts=True)
                        both, where = np.unique(np.concatenate([held[0], found]), return_inverse=True)
                        sums = [np.zeros(len(both), np.int64) for _ in range(2)]
                        for k in (0, 1):
                            sums[k][where[: len(held[0])]] = held[k + 1]
                        sums[at - 1][where[len(held[0]) :]] += times
                        held = [both, *sums]
                if len(held[0]) > HELD:
                    yield table()
                    held = [x[:0] for x in held]
        yield table()

    sums = stored(
        rows.select("trusted", "text").mapInArrow(count, "gram long, everywhere long, trusted long")
        .groupBy("gram").agg(F.sum("everywhere").alias("everywhere"), F.sum("trusted").alias("trusted")),
        "grams",
    )
    buckets = buckets or width(sums.count())
    found: pd.DataFrame = (
        sums.groupBy(F.shiftright("gram", 32 - (buckets.bit_length() - 1)).alias("bucket"))
        .agg(F.sum("everywhere").alias("everywhere"), F.sum("trusted").alias("trusted")).toPandas()
    )  # one row per bucket at most
    counts = np.zeros((2, buckets))
    counts[0, found["bucket"].to_numpy(dtype=np.int64)] = found["everywhere"].to_numpy()
    counts[1, found["bucket"].to_numpy(dtype=np.int64)] = found["trusted"].to_numpy()
    return weights(*counts)


def weights(everywhere: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Smoothed log ratio: the trusted counts get one more observation per bucket, spread as in the whole corpus."""
    if not trusted.sum():
        return np.zeros(len(everywhere))
    raw = (everywhere + 0.5) / (everywhere.sum() + 0.5 * len(everywhere))
    prior = 1e-4 * trusted.sum()
    target = (trusted + prior * raw) / (trusted.sum() + prior)
    return np.log(target) - np.log(raw)


def base(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()  # on bytes: space and \\x09-\\x0D, nothing else
    n = len(words)
    chars = np.frombuffer(text, dtype=np.uint8)
    spaces = int(np.count_nonzero((chars == 0x20) | ((chars >= 0x09) & (chars <= 0x0D))))
    points = int(np.count_nonzero(chars & 0xC0 != 0x80)) - spaces
    symbols = sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    dup = 0
    if b"\n" in text:
        lines = [line for line in text.split(b"\n") if line.strip()]
        dup = len(lines) - len(set(lines))
    repeated = 0
    if n > WINDOW:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
        if len(seen) < n:  # else no window can come twice
            _, pair = np.unique(ids[:-2] * len(seen) + ids[1:-1], return_inverse=True)
            window = pair * len(seen) + ids[2:]
            _, which, times = np.unique(window, return_inverse=True, return_counts=True)
            twice = times[which] > 1
            hit = np.zeros(n, dtype=bool)
            for k in range(WINDOW):
                hit[k : k + len(twice)] |= twice
            repeated = int(hit.sum())
    return n, points, symbols, dup, repeated


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with its counts, score and verdict."""
    rows = pick(docs, doc_id="doc_id", text="text")
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept score".split()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                score = np.fromiter((verdict(t, ratio) for t in texts), dtype=float, count=len(texts))
                counts = np.array([base(t) for t in texts], dtype=np.int64).reshape(-1, 5)
                failed = fails(counts[:, 0], counts[:, 4])
                columns = [part.column("doc_id"), *map(pa.array, counts.T), pa.array(failed)]
                columns += [pa.array(~failed & (score >= threshold)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ["long"] * 6 + ["boolean"] * 2 + ["double"]
    return rows.mapInArrow(rate, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def fails(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words)


def verdict(text: bytes, ratio: np.ndarray) -> float:
    found = grams(text, len(ratio))
    return float(ratio[found].mean()) if len(found) else 0.0


def passing(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, in one pass without an exchange."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for part in slices(batch):
                for t in part.column("text").cast(pa.binary()).to_pylist():
                    n, *_, repeated = base(t or b"")
                    good.append(not fails(n, repeated) and verdict(t or b"", ratio) >= threshold)
            yield batch.filter(pa.array(good, pa.bool_())).select(["row"])

    rows = packed(docs, text="text")
    return rows.mapInArrow(keep, rows.select("row").schema).select("row.*")
