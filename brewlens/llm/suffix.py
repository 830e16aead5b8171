"""Repeated passages through sparse suffix arrays.

A passage of ``MIN_WORDS`` words that stands twice in the corpus is found from both places, because both keep the
same suffixes: a suffix is retained where the hash of its first ``GRAM`` words is the least among ``REACH``
consecutive ones (the first of equal ones), and every ``MIN_WORDS`` words in a row hold one whole such run. Only
suffixes whose first words begin another retained suffix too go on. They are put in order by the words that follow,
and again by the words before, and each is compared with its neighbours in either order: the match is extended
right by up to ``MIN_WORDS`` words and left by up to ``REACH - 1``, which is as far as the next retained suffix can
be. Matches of ``MIN_WORDS`` words or more count, and those of one document that touch or overlap are joined.

Whole copies (equal sequences of words) are grouped by digest first; one of each group takes part, and all of them
are repeated from end to end.

A neighbour has the longest common right (or left) side, so the two orders give for each suffix the most words that any
other shares on either side. Where one neighbour shares both, every match of the suffix lies within that one. Where
none does, a match may lie between: all suffixes of that gram, one of each group with equal words on both sides, are then
keyed by windows of ``COARSE`` words, and those that meet there by each window of ``MIN_WORDS`` words round them that the
two bounds allow; a window whose key has two places is a match.

Words are maximal runs of characters other than space and ``\\x09-\\x0D``; positions count words from 0.

Defined cases: null, empty and short texts have no row; a passage repeated within one document counts; of rows equal
in doc_id and text each counts as a copy; rows with a null doc_id take part and have a null doc_id in the result;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brewlens.llm import common
from brewlens.llm.common import pick, slices, stored

MIN_WORDS, GRAM = 50, 20
REACH = MIN_WORDS - GRAM + 1
#: Words of the windows that are keyed first.
COARSE = 46
#: Odd multiplier of the rolling hash, and its inverse modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
KEY = ["id", "tie"]
#: Rows of one task of an ordered exchange.
TASK_ROWS = 1 << 16


def partitions(rows: DataFrame) -> int:
    """How many tasks an ordered exchange of stored rows gets: what they need, at most the session's number.

    Each task writes a file, and where Hadoop has no native library the executor's JVM forks to set a new file's rights.
    """
    return min(common.partitions(rows), 1 + rows.count() // TASK_ROWS)


def retained(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes that are kept, and the hash of the first words of each."""
    n = len(words)
    if n < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    one = xxhash.xxh64_intdigest
    value = np.fromiter((one(w) for w in words), dtype=np.uint64, count=n)
    power = np.full(n, BASE, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(n, UNBASE, dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power, dtype=np.uint64)])
    gram = (sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1]
    gram ^= gram >> np.uint64(31)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    runs = np.lib.stride_tricks.sliding_window_view(gram, REACH)
    at = np.unique(np.concatenate([
        k + runs[k : k + 65536].argmin(axis=1) + np.arange(len(runs[k : k + 65536]))
        for k in range(0, len(runs), 65536)
    ]))
    return at, gram[at]


def _marked(docs: DataFrame) -> DataFrame:
    """(id, tie, text): a key of its own for each document; a null doc_id becomes the least long."""
    rows = pick(docs, doc_id="doc_id", text="text").where("text is not null")
    return rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("tie"), "text")


def _suffixes(rows: DataFrame) -> DataFrame:
    """One row a document of ``MIN_WORDS`` words or more: its words' digest and its retained suffixes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                columns = (part.column(c).to_pylist() for c in KEY)
                for i, tie, text in zip(*columns, part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    words = text.split()
                    if len(words) >= MIN_WORDS:
                        at, gram = retained(words)
                        whole = xxhash.xxh3_128_digest(b" ".join(words))
                        out.append((i, tie, len(words), whole, at, gram.view(np.int64)))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                        ["id", "tie", "n_words", "whole", "at", "gram"],
                    )

    return rows.mapInArrow(find, "id long, tie long, n_words long, whole binary, at array<long>, gram array<long>")


CONTEXT = "gram long, right string, left string, id long, tie long, pos long"


def _contexts(rows: DataFrame) -> DataFrame:
    """Each surviving suffix of rows (id, tie, text, at) with the words that follow it and, nearest first, those before.

    Those with fewer than ``MIN_WORDS`` words round them have no match. A blank ends every word, so that in byte order the neighbours have the longest run of whole words in common.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                out: list[tuple] = []
                texts = part.column("text").cast(pa.binary()).to_pylist()
                rest = (part.column(c).to_pylist() for c in ("id", "tie", "found"))
                for text, i, tie, found in zip(texts, *rest, strict=True):
                    words = text.split()
                    for x in found:
                        pos = x["pos"]
                        if min(pos, REACH - 1) + min(len(words) - pos, MIN_WORDS) < MIN_WORDS:
                            continue
                        right = b"".join(w + b" " for w in words[pos : pos + MIN_WORDS]).decode()
                        left = b"".join(w + b" " for w in words[max(0, pos - REACH + 1) : pos][::-1]).decode()
                        out.append((x["gram"], right, left, i, tie, pos))
                if out:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                        ["gram", "right", "left", "id", "tie", "pos"],
                    )

    return rows.mapInArrow(cut, CONTEXT)


def _same(a: str, b: str) -> int:
    """How many words two texts share from their beginning (a blank ends each)."""
    least, most = 0, min(len(a), len(b))
    if a[:most] != b[:most]:
        while most - least > 1:
            half = (least + most) // 2
            if a[least:half] == b[least:half]:
                least = half
            else:
                most = half
    else:
        least = most
    return a.count(" ", 0, least)


def _common(a: tuple, b: tuple) -> tuple[int, int]:
    """How many words two suffixes (gram, right, left, id, tie, pos) share to the left and to the right."""
    if a[0] != b[0]:
        return 0, 0
    right = _same(a[1], b[1])
    return (_same(a[2], b[2]), right) if right >= GRAM else (0, 0)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of the types that a schema of longs, strings, binaries and booleans names."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    made = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(made, types, strict=True)], list(names))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


SPANS = "id long, tie long, first long, stop long, other long, other_first long"
#: Most words shared to the right with any suffix, and to the left and right with the best neighbour so far.
BOUNDS = "right_most long, best_left long, best_right long"
#: Rows of a pass: suffixes that go on (``first`` is null), and spans (``gram`` is null).
PASS = f"{CONTEXT}, {BOUNDS}, left_most long, {SPANS.replace('id long, tie long, ', '')}"


def _pass(rows: DataFrame, order: list[str], last: bool) -> DataFrame:
    """Compare each suffix with its neighbours in an order: ``PASS`` rows.

    The first pass orders by the words that follow and bounds ``right_most``; of suffixes with equal words on both sides,
    whose match is then whole, one goes on. The last orders by the words before and bounds ``left_most``. Suffixes whose
    bounds leave no match go no further. What touches the end of a range has unknown neighbours, so that its bound is all
    its words. ``row`` numbers the rows.
    """
    names = _names(f"{CONTEXT}, {BOUNDS}" if last else CONTEXT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(row: tuple, before: tuple | None, after: tuple | None, copy: bool) -> list[tuple]:
            """Rows of one suffix from (left, right, neighbour) on either side; None at the end of a range."""
            near = [x for x in (before, after) if x]
            held_right, left, right = row[6:] if last else (0, 0, 0)
            out: list[tuple] = []
            for x in sorted(near, key=lambda x: -x[0] - x[1]):
                if x[0] + x[1] >= MIN_WORDS and (x[0] > left or x[1] > right):
                    at, other = row[5], x[2]
                    out.append((*[None] * 3, *row[3:5], *[None] * 5, at - x[0], at + x[1], other[3], other[5] - x[0]))
                if x[0] + x[1] > left + right:
                    left, right = x[:2]
            if copy:
                return out
            every = row[2 if last else 1].count(" ")
            most = max(x[0 if last else 1] for x in near) if len(near) == 2 else every
            bounds = (held_right, most) if last else (most, row[2].count(" "))
            if sum(bounds) >= MIN_WORDS:
                out.append((*row[:6], bounds[0], left, right, bounds[1], *[None] * 4))
            return out

        row, before, copy = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for new in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if row is not None:
                    shared = _common(row, new)
                    out += finish(row, before, (*shared, new), copy)
                    before, copy = (*shared, row), not last and row[:3] == new[:3]
                row = new
            yield _table(out, PASS)
        if row is not None:
            yield _table(finish(row, before, None, copy), PASS)

    ranges = [*order, *KEY, "pos"]
    put = rows.select(*names).repartitionByRange(partitions(rows), *ranges).sortWithinPartitions(*ranges)
    return stored(put.mapInArrow(compare, PASS).withColumn("row", F.monotonically_increasing_id()), "neighbours")


LINKED = "row long, back long, met long"


def _linked(keys: DataFrame) -> DataFrame:
    """(row, back, met): rows (key, row, back) whose key another row has too, with one such row.

    Equal keys lie side by side, and a range may end between them: the ends are compared by themselves.
    """
    schema = f"part long, {LINKED}, key binary"

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, met, first = TaskContext.get().partitionId(), None, None, True
        for batch in batches:
            out: list[tuple] = []
            for new in zip(*(batch.column(n).to_pylist() for n in ("key", "row", "back")), strict=True):
                if held is None:
                    out.append((part, *new[1:], None, new[0]))
                else:
                    same = held[0] == new[0]
                    if same and first:
                        out.append((part, *held[1:], new[1], None))
                    elif same or met is not None:
                        out.append((part, *held[1:], new[1] if same else met, None))
                    met, first = held[1] if same else None, False
                held = new
            yield _table(out, schema)
        if held is not None:
            ends = [(part, *held[1:], met, None)] if met is not None else []
            yield _table([*ends, (part, *held[1:], None, held[0])], schema)

    put = keys.repartitionByRange(partitions(keys), "key", "row").sortWithinPartitions("key", "row")
    found = stored(put.mapInArrow(link, schema), "linked")
    # One first and one last row for each range of the exchange.
    order = Window.orderBy("part", "key", "row")
    sides = [F.when(f("key").over(order) == F.col("key"), f("row").over(order)) for f in (F.lag, F.lead)]
    ends = found.where("key is not null").select("row", "back", F.array(*sides).alias("met")).withColumn("met", F.explode("met"))
    return found.where("key is null").select("row", "back", "met").unionByName(ends.where("met is not null and met != row"))


def _keyed(rows: DataFrame, size: int, step: int) -> DataFrame:
    """(key, row, back) of windows of ``size`` words that begin ``back`` words before a suffix, every ``step`` words.

    Only those within a window of ``MIN_WORDS`` that the bounds allow.
    """
    schema = "key binary, row long, back long"
    spare = MIN_WORDS - size

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_digest if spare else xxhash.xxh3_128_digest
        names = ["right", "left", "row", "left_most", "right_most"]
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part, out = batch.slice(k, 4096), []
                for right, left, row, before, after in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                    words = left.split(" ")[-2::-1] + right.split(" ")[:-1]
                    anchor = left.count(" ")
                    for back in range(0, before + 1, step):
                        if max(back, MIN_WORDS - after) <= min(back + spare, before):
                            window = " ".join(words[anchor - back : anchor - back + size])
                            out.append((digest(f"{back} {window}".encode()), row, back))
                yield _table(out, schema)

    return stored(rows.mapInArrow(key, schema), "keys")


def _between(suffixes: DataFrame) -> DataFrame:
    """Spans of the grams some suffix of which shares its most to the left and to the right with different neighbours.

    Two suffixes that match lie within each other's bounds, so both have the key of each window they share. A window of
    ``MIN_WORDS`` holds one of ``COARSE`` words at every ``MIN_WORDS - COARSE + 1``-th place; only what meets there has
    all its windows keyed.
    """
    open_grams = suffixes.where("best_left + best_right < left_most + right_most").select("gram").distinct()
    asked = suffixes.join(open_grams, "gram", "left_semi")
    coarse = _linked(_keyed(asked, COARSE, MIN_WORDS - COARSE + 1)).select("row").distinct()
    found = _linked(_keyed(suffixes.join(coarse, "row", "left_semi"), MIN_WORDS, 1))
    spans = found.groupBy("row", "met").agg(F.max("back").alias("back"), F.min("back").alias("least_back"))
    place = suffixes.select("row", *KEY, "pos")
    met = suffixes.select(F.col("row").alias("met"), F.col("id").alias("other"), F.col("pos").alias("other_pos"))
    return spans.join(place, "row").join(met, "met").select(
        *KEY, (F.col("pos") - F.col("back")).alias("first"),
        (F.col("pos") - F.col("least_back") + MIN_WORDS).alias("stop"),
        "other", (F.col("other_pos") - F.col("back")).alias("other_first"),
    )


def _joined(spans: DataFrame) -> DataFrame:
    """Touching and overlapping spans of a document as one; the match of the longest stays."""
    order = Window.partitionBy(*KEY).orderBy("first", "stop")
    ahead = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.coalesce((F.col("first") > ahead).cast("int"), F.lit(1)))
    number = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    longest = F.max_by(F.struct("other", "other_first"), F.struct(F.col("stop") - F.col("first"), "other", "other_first"))
    return (
        new.withColumn("island", number).groupBy(*KEY, "island")
        .agg(F.min("first").alias("start"), F.max("stop").alias("stop"), longest.alias("match"))
        .select(*KEY, "start", "stop", F.col("match.other").alias("other"), F.col("match.other_first").alias("other_start"))
    )


def _plain(c: str) -> Column:
    return F.when(F.col(c) != -(1 << 63), F.col(c))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_words, match_doc_id and match_start of every repeated passage; documents without one have no row.

    Positions are in words. The match is one other occurrence, of the longest single match within the passage.
    """
    rows = _marked(docs)
    # Classes and grams are stored, so that joins with them can be broadcast or split where one is very frequent.
    found = stored(_suffixes(rows), "suffixes")
    place = F.struct("id", "tie")
    classes = stored(
        found.groupBy("whole").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.count("*").alias("copies")),
        "classes",
    )
    speakers = classes.select("least.*").distinct()
    kept = found.join(speakers, KEY, "left_semi").select(*KEY, F.explode(F.arrays_zip("at", "gram")).alias("s"))
    seeds = stored(kept.select(*KEY, "s.at", "s.gram"), "seeds")
    twice = stored(seeds.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "twice")
    lasting = seeds.join(twice, "gram").groupBy(*KEY).agg(F.collect_set(F.struct("gram", F.col("at").alias("pos"))).alias("found"))
    contexts = stored(_contexts(rows.join(lasting, KEY)), "contexts")
    by_right = _pass(contexts, ["gram", "right", "left"], last=False)
    by_left = _pass(by_right.where("gram is not null"), ["gram", "left", "right"], last=True)
    spans = by_right.unionByName(by_left).where("gram is null").select(*_names(SPANS))
    joined = _joined(spans.unionByName(_between(by_left.where("gram is not null"))).distinct())
    alone = classes.where("copies = 1").select("least.*")
    single = joined.join(alone, KEY, "left_semi").select(
        "id", "start", (F.col("stop") - F.col("start")).alias("n_words"), "other", "other_start"
    )
    several = found.select(*KEY, "n_words", "whole").join(
        classes.where("copies > 1").select("whole", "least", "most"), "whole"
    )
    other = F.when((F.col("id") == F.col("least.id")) & (F.col("tie") == F.col("least.tie")), F.col("most.id"))
    copied = several.select(
        "id", F.lit(0).cast("long").alias("start"), "n_words", F.coalesce(other, F.col("least.id")).alias("other"),
        F.lit(0).cast("long").alias("other_start"),
    )
    return single.unionByName(copied).select(
        _plain("id").alias("doc_id"), "start", "n_words", _plain("other").alias("match_doc_id"),
        F.col("other_start").alias("match_start"),
    )
