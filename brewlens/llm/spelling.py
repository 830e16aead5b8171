"""Spelling variants: candidates from one-edit neighbourhoods in a reduced alphabet.

Letters are hashed to a few symbols, so that words become shorter-alphabet words whose one-edit neighbourhoods are
small. Two words one edit apart have reduced words at most one edit apart: the reduced vocabulary is joined with the
neighbourhoods (keys are 64-bit hashes of reduced words), and a pair counts if the original words are one edit apart. Being near
is symmetric, so of the two directions one is generated: shorter words by deletion, replacements by greater symbols,
and the reduced word itself, which stands for replacements inside a symbol.

A word's form is the most frequent near word if that is ``ratio`` times as frequent; roots follow forms to the last.
Words are numbered in code-point order, so numbers stand for words in joins, and word texts beyond ``SHORT`` letters are
fetched only to check a candidate: a letter run of any length costs rows, not copies of itself.

Defined cases: null text has no words, null doc_id counts as the empty text; texts are read whole; repeated rows count
again; of equally frequent near words the first in code-point order is the form; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brewlens.llm.common import partitions, pick, slices, stored

SYMBOLS, SHORT = 6, 48
LEAST_LETTERS, LEAST_TIMES, RATIO = 7, 2, 10
#: Of the hashes of (doc_id, run) those divisible by this take a letter out of the run.
DAMAGE = 31
#: Words a task counts before it hands them on; letters whose neighbours are made at a time.
HELD, LETTERS = 400_000, 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words_of(doc_id: object, text: str, letters: int = LEAST_LETTERS) -> Counter:
    """Words of one text (its A-Z in lower case) with their times; one hash decides for all equal runs of a document."""
    found: Counter = Counter()
    name = "" if doc_id is None else str(doc_id)
    for run, times in Counter(m[0] for m in re.finditer(f"[a-zÀ-ÿ]{{{letters},}}", text)).items():
        h = zlib.crc32(f"{name}:{run}".encode())
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= letters:
            found[run] += times
    return found


def vocabulary(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_TIMES) -> DataFrame:
    """(wid, word, n) of all words with ``least`` occurrences; ``wid`` grows in code-point order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), pc.ascii_lower(part.column("text")).to_pylist(), strict=True):
                    held.update(words_of(doc_id, text, letters))
                    if len(held) >= HELD:
                        yield send()
                        held.clear()
        yield send()

    rows = pick(docs, doc_id="doc_id", text="text").where("text is not null").withColumn("doc_id", F.col("doc_id").cast("string"))
    total = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    ordered = stored(total, "counted").repartitionByRange(partitions(docs), "word").sortWithinPartitions("word")
    return stored(ordered.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "vocabulary")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def symbol_table(symbols: int = SYMBOLS) -> np.ndarray:
    """Symbol 1 to ``symbols`` of each code point below 256."""
    return ((np.arange(256, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(13)) % np.uint64(symbols)).astype(np.int64) + 1


def neighbours(words: list[str], symbols: int = SYMBOLS, own_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, place in ``words``, whether it is the reduced word itself) of the smaller half of all neighbourhoods."""
    lengths = np.array([len(w) for w in words])
    code = symbol_table(symbols)[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    of = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(code)) - starts[of]
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _BASE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(code.astype(np.uint64) * power[at])])
    whole = sums[ends] - sums[starts]

    def key(h: np.ndarray, length: np.ndarray) -> np.ndarray:
        return _mixed(h + length.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)

    yield key(whole, lengths), np.arange(len(words)), np.ones(len(words), bool)
    if own_only:
        return
    for low in range(0, len(code), LETTERS):
        i = np.arange(low, min(low + LETTERS, len(code)))
        last = i + 1 == ends[of[i]]
        drop = i[last | (code[i] != code[np.minimum(i + 1, len(code) - 1)])]  # one letter of each run of a symbol
        w = of[drop]
        rest = (sums[ends[w]] - sums[drop + 1]) * _BACK
        yield key(sums[drop] - sums[starts[w]] + rest, lengths[w] - 1), w, np.zeros(len(drop), bool)
        for more in range(1, symbols):
            put = i[code[i] + more <= symbols]
            w = of[put]
            yield key(whole[w] + np.uint64(more) * power[at[put]], lengths[w]), w, np.zeros(len(put), bool)


def _keyed(words: DataFrame, symbols: int, own_only: bool) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word", 1 << 16):
                rest = part.drop_columns("word")
                for key, of, own in neighbours(part["word"].to_pylist(), symbols, own_only):
                    rows = rest.take(pa.array(of))
                    yield pa.RecordBatch.from_arrays([pa.array(key), *rows.columns, pa.array(own)], ["key", *rows.schema.names, "own"])

    short = F.when(F.length("word") <= SHORT, F.col("word"))
    return words.select("wid", "n", short.alias("short"), "word").mapInArrow(make, "key long, wid long, n long, short string, own boolean")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, na, b, nb): the numbers and times of each two words one edit apart, in one direction."""
    one = _keyed(words, symbols, False).select("key", F.col("wid").alias("a"), F.col("n").alias("na"), F.col("short").alias("sa"), "own")
    two = _keyed(words, symbols, True).select("key", F.col("wid").alias("b"), F.col("n").alias("nb"), F.col("short").alias("sb"))
    edit = F.levenshtein("sa", "sb", 1) == 1
    met = one.join(two, "key").where((~F.col("own") | (F.col("a") < F.col("b"))) & F.coalesce(edit, F.lit(True)))
    met = stored(met.select("a", "na", "b", "nb", edit.isNull().alias("open")).distinct(), "met")
    texts = words.where(F.length("word") >= SHORT)  # an open pair has one longer word at least
    opened = met.where("open").join(texts.select(F.col("wid").alias("a"), F.col("word").alias("ta")), "a").join(
        texts.select(F.col("wid").alias("b"), F.col("word").alias("tb")), "b"
    ).where(F.levenshtein("ta", "tb", 1) == 1)
    return met.where("not open").drop("open").unionByName(opened.select("a", "na", "b", "nb"))


def _roots(links: DataFrame) -> DataFrame:
    """(a, root) of all words with a form: jumps double, and each step multiplies frequency, so that few rounds do."""
    current = stored(links.select("a", F.col("b").alias("root")), "roots")
    while True:
        onward = current.select(F.col("a").alias("root"), F.col("root").alias("onward"))
        moved = stored(current.join(onward, "root", "left").select("a", "root", "onward"), "roots")
        if moved.where("onward is not null").isEmpty():
            return moved.select("a", "root")
        current = moved.select("a", F.coalesce("onward", "root").alias("root"))


def variants(docs: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = vocabulary(docs)
    pairs = stored(near_pairs(words, symbols), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = F.min(F.struct((-F.col("nb")).alias("less"), "b")).alias("best")
    near = stored(both.groupBy("a").agg(F.count("*").alias("n_near"), F.first("na").alias("na"), best), "best")
    linked = -F.col("best.less") >= ratio * F.col("na")
    links = stored(near.where(linked).select("a", F.col("best.b").alias("b"), (-F.col("best.less")).alias("form_n")), "links")
    named = links.join(_roots(links), "a")
    named = named.join(words.select(F.col("wid").alias("b"), F.col("word").alias("form")), "b").join(
        words.select(F.col("wid").alias("root"), F.col("word").alias("last")), "root"
    )
    return (
        words.withColumnRenamed("wid", "a")
        .join(near.select("a", "n_near"), "a", "left")
        .join(named.select("a", "form", "last", "form_n"), "a", "left")
        .select(
            "word", "form", F.coalesce("last", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
        )
    )
