"""Phrases by the stripes pattern: each prefix keys a counter of the words that follow it.

A task keeps stripes (prefix -> next word -> times) of its texts and hands on their entries, packed in one row for each
part of the hash space; entries are added up element by element, so that the stripe of a frequent prefix is spread over
the parts instead of being one row. Where a word is followed by the end of its piece, or by a word with which it is not
frequent, the entry's next word is null; so a word's stripe adds up to its frequency, and that of a longer prefix is an
entry one level below. One structure then holds it all: an entry is the frequency of a phrase, a total that of a word,
the greatest entry of a stripe is the most frequent longer phrase to the right, and the one to the left is the
greatest entry among phrases that end alike.

Stripes hold only what may be frequent. Three passes before find that out level by level, as a phrase is no more frequent
than its parts: words, pairs of frequent words, longer phrases of frequent pairs. A task sends hashes and counts, packed
in sorted runs, one row for each part of the hash space; a part's sums set bits in a set of fixed size (``BITS``) that the
next pass gets. Bits have no false negatives and strings are counted exactly, so hashes decide nothing but what is
sent. When the sets fill up, stripes get more entries that fall away later, and nothing else changes.

Inside a task words are numbers: texts are cut into units of about ``UNIT`` bytes, their words encoded by a dictionary
and phrases numbered level by level, without a hash.

Defined cases: null text is empty, null lang is ``und``; a text is read whole: one longer than a unit is cut between
pieces, or between words so that each phrase begins in one unit only; repeated rows count again; an empty table gives
no rows; ties end in the order of the phrase's bytes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brewlens.llm.common import partitions, pick, slices, stored

LONGEST = 5
#: Bits of a set of hashes: 4 MB on the driver and in a task.
BITS = 1 << 25
#: Bytes of text that are looked at in one piece.
UNIT = 1 << 24

#: Lower case for A-Z only; ends of pieces become line feeds, tabs blanks. What remains splits as bytes.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(10 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
ENTRY = "lang string, prefix string, next string, n long"
PACKED = "part int, lang string, prefix array<string>, next array<string>, n array<long>"


# --- texts in units -----------------------------------------------------------------------------------------------


def _long_units(text: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    start, span = 0, most
    while len(text) - start > span:
        cut = text.rfind(b"\n", start, start + span)
        if cut > start:
            yield text[start:cut], 0
            start, span = cut, most
            continue
        cut = back = text.rfind(b" ", start, start + span)
        for _ in range(LONGEST - 1):  # back to the first of the last words of this unit
            while back > start and text[back - 1] == 32:
                back -= 1
            back = max(start, text.rfind(b" ", start, max(back, start)) + 1)
        if cut <= start or back <= start:
            span *= 2  # a few very long words
            continue
        yield text[start:cut], LONGEST - 1
        start, span = back, most
    yield text[start:], 0


def units(texts: list[bytes], most: int) -> Iterator[tuple[bytes, int]]:
    """(folded text, words at its end that begin phrases in the next unit only) of about ``most`` bytes each."""
    held, size = [], 0
    for text in texts:
        if len(text) > most:
            yield from _long_units(text.translate(_FOLD), most)
            continue
        if size + len(text) > most:
            yield b"\n".join(held).translate(_FOLD), 0
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield b"\n".join(held).translate(_FOLD), 0


def numbered_words(text: bytes) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray]:
    """(number of each word, the words behind the numbers, whether the next word is in the same piece)."""
    raw = np.frombuffer(text, np.uint8)
    letter = (raw != 32) & (raw != 10)
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[letter])]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(raw == 10), starts)
    return np.asarray(found.indices).astype(np.int64), found.dictionary, np.append(piece[1:] == piece[:-1], False)[: len(starts)]


# --- what may be frequent --------------------------------------------------------------------------------------------


def _mixed(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its prefix and its last word."""
    h = prefix * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _in_set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(65 - (len(bits) * 8).bit_length())).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _word_hashes(lang: str, words: pa.BinaryArray) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()], np.uint64)


def _chained(fits: np.ndarray, joined: np.ndarray, hashes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of phrases one word longer: both their parts without the last and without the first word fit."""
    follows = np.append(fits[1:], False)
    at = np.flatnonzero(fits & follows & joined)
    return at, _mixed(hashes[at], last[at])


class Levels:
    """The words of one unit, and for each level up to those known which positions begin a phrase that may be frequent."""

    def __init__(self, lang: str, text: bytes, tail: int, sets: list[np.ndarray]) -> None:
        self.ids, self.words, joined = numbered_words(text)
        self.own = len(self.ids) - tail
        self.joined = [joined]  # whether the next word (the second, the third, ...) is in the same piece
        for _ in range(LONGEST - 2):
            self.joined.append(self.joined[-1] & np.append(self.joined[-1][1:], False))
        word_hashes = _word_hashes(lang, self.words)
        self.hashes = [word_hashes[self.ids] if len(self.ids) else np.zeros(0, np.uint64)]
        known = _in_set(sets[0], word_hashes)[self.ids] if sets and len(self.ids) else np.ones(len(self.ids), bool)
        self.fits = [known]
        for level in range(1, (1, 2, LONGEST, LONGEST)[len(sets)]):
            self.extend(sets[min(level, 2)] if min(level, 2) < len(sets) else None)

    def extend(self, bits: np.ndarray | None) -> None:
        level = len(self.fits)
        last = np.append(self.hashes[0][level:], np.zeros(min(level, len(self.ids)), np.uint64))
        at, found = _chained(self.fits[-1], self.joined[level - 1], self.hashes[-1], last)
        keep = slice(None) if bits is None else _in_set(bits, found)
        fits, hashes = np.zeros(len(self.ids), bool), np.zeros(len(self.ids), np.uint64)
        fits[at[keep]], hashes[at[keep]] = True, found[keep]
        self.fits.append(fits)
        self.hashes.append(hashes)

    def begun(self, level: int) -> np.ndarray:
        """Positions of phrases of ``level`` + 1 words that begin in this unit."""
        at = np.flatnonzero(self.fits[level])
        return at[at < self.own]


def _texts_by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for part in slices(batch):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            if sum(sizes.values()) >= UNIT:
                fullest = max(sizes, key=sizes.get)
                del sizes[fullest]
                yield fullest, held.pop(fullest)
    yield from held.items()


def _analysed(batches: Iterator[pa.RecordBatch], sets: list[Broadcast]) -> Iterator[tuple[str, Levels]]:
    bits = [np.frombuffer(s.value, np.uint8) for s in sets]
    for lang, texts in _texts_by_lang(batches):
        for text, tail in units(texts, UNIT):
            yield lang, Levels(lang, text, tail, bits)


def _part_bits(df: DataFrame) -> int:
    """The hash space has as many parts as a shuffle has partitions, a power of two and 256 at least."""
    return max(8, min((partitions(df) - 1).bit_length(), 18))


def _frequent(texts: DataFrame, sets: list[Broadcast], levels: range, least: int) -> Broadcast:
    """The set of hashes of phrases of these levels that occur ``least`` times or more (and of some others).

    A part's sums meet in one group, whose size is that of any shuffle partition, and give one slice of the bits. The driver
    gets ``BITS`` bits in all.
    """
    p = _part_bits(texts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit in _analysed(batches, sets):
            found = np.concatenate([unit.hashes[level][unit.begun(level)] for level in levels])
            found = np.sort(found >> np.uint64(32 - p))  # p bits say the part, 32 the place in it
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))[: len(found)]
            times, found = np.diff(np.append(first, len(found))).astype(np.uint32), found[first]
            cuts = np.searchsorted(found, np.arange((1 << p) + 1, dtype=np.uint64) << np.uint64(32))
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            low = found.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                pa.array(some.astype(np.int32)),
                pa.array([low[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()),
                pa.array([times[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()),
            ], ["part", "places", "times"])

    def add(group: pa.Table) -> pa.Table:
        places = np.concatenate([np.frombuffer(b, np.uint32) for b in group["places"].to_pylist()])
        times = np.concatenate([np.frombuffer(b, np.uint32) for b in group["times"].to_pylist()]).astype(np.int64)
        order = np.argsort(places, kind="stable")
        places, times = places[order], times[order]
        first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        usual = places[first][np.add.reduceat(times, first) >= least]
        bits = np.zeros(BITS >> p, bool)
        bits[usual >> np.uint32(32 + p - BITS.bit_length() + 1)] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"part": group["part"][:1], "bits": pa.array([packed], pa.binary())})

    sent = texts.mapInArrow(send, "part int, places binary, times binary")
    found = sent.groupBy("part").applyInArrow(add, "part int, bits binary").toArrow()
    held = bytearray(BITS // 8)
    width = BITS // 8 >> p
    for part, bits in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        held[part * width : (part + 1) * width] = bits
    return texts.sparkSession.sparkContext.broadcast(bytes(held))


# --- stripes ---------------------------------------------------------------------------------------------------------


def entries(unit: Levels) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]]:
    """(hash, prefix, next, times) of the stripes of one unit; the empty prefix has one entry, of all words."""
    yield np.zeros(1, np.uint64), pa.array([b""]), pa.array([None], pa.binary()), np.array([unit.own])
    words = unit.words.cast(pa.binary())
    phrases, number = words, unit.ids  # at each position the number of the phrase of this level that begins there
    for level in range(LONGEST - 1):
        on = np.flatnonzero(unit.fits[level + 1])
        codes, first, longer = np.unique(number[on] * len(words) + unit.ids[on + level + 1], return_index=True, return_inverse=True)
        prefix, after = np.divmod(codes, max(len(words), 1))
        times = np.bincount(longer[on < unit.own], minlength=len(codes))
        before, last = phrases.take(pa.array(prefix)), words.take(pa.array(after))
        here = np.flatnonzero(times)
        yield unit.hashes[level + 1][on[first]][here], before.take(pa.array(here)), last.take(pa.array(here)), times[here]
        if level == 0:
            at = unit.begun(0)
            total, places = np.bincount(unit.ids[at], minlength=len(words)), np.zeros(len(words), np.int64)
            places[unit.ids] = np.arange(len(unit.ids))
            rest = total - np.bincount(prefix, times, len(words)).astype(np.int64)
            left = np.flatnonzero(rest)
            yield unit.hashes[0][places[left]], words.take(pa.array(left)), pa.nulls(len(left), pa.binary()), rest[left]
        phrases = pc.binary_join_element_wise(before, last, b" ")
        number = np.zeros(len(unit.ids), np.int64)
        number[on] = longer


def _packed(lang: str, unit: Levels, p: int) -> pa.RecordBatch:
    """Entries of one unit, one row for each part of the hash space that has some."""
    found = list(entries(unit))
    part = (np.concatenate([f[0] for f in found]) >> np.uint64(64 - p)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    offsets = pa.array(np.append(cuts, len(part)).astype(np.int32))
    prefix, after = (pa.concat_arrays([f[i] for f in found]).take(pa.array(order)).cast(pa.string()) for i in (1, 2))
    times = np.concatenate([f[3] for f in found])[order]
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (prefix, after, pa.array(times, pa.int64()))]
    return pa.RecordBatch.from_arrays(
        [pa.array(part[cuts]), pa.array([lang] * len(cuts), pa.string()), *lists], ["part", "lang", "prefix", "next", "n"]
    )


def stripes(docs: DataFrame, least: int) -> DataFrame:
    """Stripes (lang, prefix, next, n): the empty prefix with all words, words, and prefixes of two to four words.

    Entries below ``least`` fall away but for a word's, which become part of its null entry.
    """
    texts = pick(docs, lang="lang", text="text").where("text is not null").withColumn("lang", F.coalesce("lang", F.lit("und")))
    sets: list[Broadcast] = []
    for levels in (range(1), range(1, 2), range(2, LONGEST)):
        sets.append(_frequent(texts, sets, levels, least))
    p = _part_bits(texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, unit in _analysed(batches, sets):
            yield _packed(lang, unit, p)

    def merge(group: pa.Table) -> pa.Table:
        rows = group.combine_chunks()
        lists = [rows[c].chunk(0) if rows[c].num_chunks else rows[c] for c in ("prefix", "next", "n")]
        lang = rows["lang"].take(pc.list_parent_indices(lists[0]))
        flat = pa.table([lang, *[x.flatten() for x in lists]], ["lang", "prefix", "next", "n"])
        return flat.group_by(["lang", "prefix", "next"]).aggregate([("n", "sum")]).rename_columns(["lang", "prefix", "next", "n"])

    added = texts.mapInArrow(count, PACKED).groupBy("part").applyInArrow(merge, ENTRY)
    usual = F.col("n") >= least
    short = ~F.contains("prefix", F.lit(" "))
    kept = added.where(usual | short).select("lang", "prefix", F.when(usual, F.col("next")).alias("next"), "n")
    return stored(kept.groupBy("lang", "prefix", "next").agg(F.sum("n").alias("n")), "stripes")


def score() -> Column:
    """floor(1000 * a * n / (l * r)) in whole numbers of 38 digits."""
    a, n, l, r = (f"cast({c} as decimal(19, 0))" for c in "anlr")
    return F.expr(f"cast(1000 * {a} as decimal(19, 0)) * {n} div ({l} * {r})")


def phrases(docs: DataFrame, least: int = 100, first: int = 2000, share: int = 100) -> DataFrame:
    """The ``first`` phrases a language (lang, rank, phrase, a, l, r, n, score).

    A phrase of 2 to 5 words counts from ``least`` occurrences on, and not where a longer one that holds it has ``share``
    hundredths of them: its extensions by one word decide, as a longer phrase is no more frequent than they are.
    """
    held = stripes(docs, least)
    sizes = held.where("prefix = ''").select("lang", "n")
    entries = held.where("prefix <> ''")
    found = stored(
        entries.where("next is not null").select(
            "lang", "prefix", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("n").alias("a")
        ).withColumn("words", F.split("phrase", " ")),
        "found",
    )
    single = entries.where("not contains(prefix, ' ')").groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("n").alias("f"))
    totals = stored(single.where(F.col("f") >= least).unionByName(found.select("lang", "phrase", F.col("a").alias("f"))), "totals")
    left = found.where(F.size("words") > 2).groupBy(
        "lang", F.expr("array_join(slice(words, 2, size(words) - 1), ' ')").alias("phrase")
    ).agg(F.max("a").alias("left"))
    right = found.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("a").alias("right"))
    most = F.greatest(F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0)))
    kept = found.join(left, ["lang", "phrase"], "left").join(right, ["lang", "phrase"], "left").where(
        100 * most < share * F.col("a")
    ).select("lang", "phrase", "a", "words")

    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("one"),
        F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("two"),
    )
    cuts = cuts.join(totals.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l")), ["lang", "one"])
    cuts = cuts.join(totals.select("lang", F.col("phrase").alias("two"), F.col("f").alias("r")), ["lang", "two"])
    scored = cuts.join(sizes, "lang").withColumn("score", score()).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn(
        "rank", F.row_number().over(order).cast("long")
    ).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
