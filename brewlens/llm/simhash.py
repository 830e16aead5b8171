"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into five segments. Four differing bits leave one segment untouched and, among the
rest, a pair with at most one error each, or none and two. Segments are read as words of the perfect (23, 12)
Golay code, in which every word lies within three bits of exactly one codeword: a segment's *index* is that
codeword, its *near indices* are those of itself and of every word one bit away. Two segments one bit apart share
the index of one among the near indices of the other; two bits apart, they share a near index, that of a word
between them. So for each untouched segment and each of two pairs (b, c) of the others a fingerprint emits

    (segment, index of b, near indices of c)  and  (segment, near indices of b, index of c)

and any two fingerprints within four bits meet under one key. Each meeting is verified by its bits. Within a key,
links are walked breadth-first, which gives one link per further member and not one per pair. Keys that hold more
than ``block`` fingerprints are cut into blocks, and every pair of blocks is walked in a task of its own.

Only distinct fingerprints take part, so copies are never compared; components are then found on the links.

Defined cases: null and empty texts have fingerprint zero and link like any other; a component without any
doc_id has a null component_id; rows that share a ``doc_id`` or repeat are fingerprinted each; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brewlens.llm.common import numbered, only, partitions, pick, slices, stored
from brewlens.llm.components import components

SEED, SHINGLE, DISTANCE = 42, 4, 4
#: Widths of the segments, lowest bits first, and for each untouched segment two pairs of the others.
WIDTHS = (13, 13, 13, 13, 12)
COMBINATIONS = [
    (a, rest[i], rest[j])
    for a in range(5)
    for rest in [[s for s in range(5) if s != a]]
    for i, j in ((0, 1), (2, 3))
]
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Fingerprints of one key that are walked in one task.
BLOCK = 8192


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # on bytes: A-Z; space and \\x09-\\x0D
    if not words:
        return 0
    n = len(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=n) + 1
    ends = np.cumsum(size)
    starts = (ends - size)[: n - SHINGLE + 1].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (one(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=len(starts)
    )
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """(rid, doc_id, fp) of rows (rid, doc_id, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = [fingerprint(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
                signed = pa.array(np.array(made, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), signed], ["rid", "doc_id", "fp"]
                )

    return rows.select("rid", "doc_id", "text").mapInArrow(make, "rid long, doc_id long, fp long")


@cache
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each 23-bit unit vector, and the error of at most three bits behind each remainder."""
    unit = np.zeros(23, dtype=np.int64)
    for i in range(23):
        value = 1 << i
        for bit in range(22, 10, -1):
            if value >> bit & 1:
                value ^= GOLAY << (bit - 11)
        unit[i] = value
    error = np.zeros(1 << 11, dtype=np.int64)
    for i in range(23):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return unit, error


def index(words: np.ndarray) -> np.ndarray:
    """Index (its upper twelve bits) of the codeword nearest to each 23-bit word."""
    unit, error = _decoder()
    rest = np.zeros_like(words)
    for i in range(23):
        rest ^= np.where(words >> i & 1, unit[i], 0)
    return (words ^ error[rest]) >> 11


@cache
def _near(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value of a segment: its index, its near indices without repeats (flat), and where they begin."""
    value = np.arange(1 << width, dtype=np.int64)
    place = 23 - width  # the segment's bits stand first, zeros follow
    own = index(value << place)
    around = np.stack([own, *[index((value ^ 1 << i) << place) for i in range(width)]], axis=1)
    lists = [np.unique(row) for row in around]
    return own, np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned fingerprints, and for each key the position of its fingerprint."""
    low = np.cumsum([0, *WIDTHS[:-1]])
    parts = [
        (fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        for at, width in zip(low, WIDTHS, strict=True)
    ]
    own = [_near(w)[0][p] for w, p in zip(WIDTHS, parts, strict=True)]
    out, who = [], []
    for number, (a, b, c) in enumerate(COMBINATIONS):
        head = (np.int64(number) << 13 | parts[a]) << 24
        for seg, fixed in ((c, own[b] << 12), (b, own[c])):
            _, flat, begin = _near(WIDTHS[seg])
            first, size = begin[parts[seg]], np.diff(begin)[parts[seg]]
            at = np.repeat(np.arange(len(fps)), size)
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            near = flat[first[at] + step]
            own_too = near == own[seg][at]
            key = (head | fixed)[at] | (near if seg == c else near << 12)
            new = ~own_too if seg == b else slice(None)  # (index, index) came with the first of the two
            out.append(key[new])
            who.append(at[new])
    return np.concatenate(out), np.concatenate(who)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect exactly what links within ``DISTANCE`` bits connect; one per member reached."""
    links, left = [], fps
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= DISTANCE
            if near.any():
                found = left[near]
                links += [(int(at), int(x)) for x in found]
                front += list(found)
                left = left[~near]
    return links


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _links(group: np.ndarray) -> list[tuple[int, int]]:
    return forest(np.unique(group.astype(np.int64).view(np.uint64)))


def _walk(columns: int, block: int | None):
    """Walks sorted rows (columns of a key, fp); without ``block``, groups are known to fit.

    Rows out: kind 0 a link (a, b), kind 1 a fingerprint b of a split key a and its block c, kind 2 a split key a
    and its number of blocks c.
    """

    def table(kind: int, rows: list[tuple]) -> pa.RecordBatch:
        full = [(*r, 0) if len(r) == 2 else r for r in rows]
        a, b, c = (np.array([r[i] for r in full], dtype=np.uint64 if kind == 0 else np.int64) for i in range(3))
        if kind == 0:
            a, b, c = (x.view(np.int64) for x in (a, b, c))
        n = len(full)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), *map(pa.array, (a, b, c))],
            ["kind", "a", "b", "c"],
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        done = 0  # blocks of the current key that have been sent
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(columns + 1)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            begin = _runs(now[:columns])
            links: list[tuple[int, int]] = []
            for first, stop in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                if done:
                    yield from last_block([x[first:stop] for x in now], done)
                    done = 0
                elif stop - first > 1:
                    links += _links(now[-1][first:stop])
            rest = [x[begin[-1] :].copy() for x in now] if len(begin) else None
            while block and rest is not None and len(rest[0]) > block:
                yield table(1, [(int(rest[0][0]), int(f), done) for f in rest[-1][:block]])
                rest, done = [x[block:] for x in rest], done + 1
            if links:
                yield table(0, links)
        if rest is not None:
            if done:
                yield from last_block(rest, done)
            elif len(rest[0]) > 1:
                yield table(0, _links(rest[-1]))

    def last_block(now: list[np.ndarray], number: int) -> Iterator[pa.RecordBatch]:
        yield table(1, [(int(now[0][0]), int(f), number) for f in now[-1]])
        yield table(2, [(int(now[0][0]), 0, number + 1)])

    return walk


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) within ``DISTANCE`` bits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                own = batch.column("fp").slice(k, 4096).to_numpy()
                made, who = keys(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(made), pa.array(own[who])], ["key", "fp"])

    rows = fps.select("fp").mapInArrow(emit, "key long, fp long")
    met = stored(
        rows.repartition(partitions(fps), "key").sortWithinPartitions("key", "fp")
        .mapInArrow(_walk(1, block), "kind int, a long, b long, c long"),
        "links",
    )
    found = met.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    sizes = met.where("kind = 2").select("a", F.col("c").alias("blocks"))
    if sizes.isEmpty():
        return found
    # A split key: row of block i goes to every pair of blocks that has i.
    members = met.where("kind = 1").select("a", F.col("b").alias("fp"), F.col("c").alias("i")).join(sizes, "a")
    pairs = members.select("a", "i", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")).select(
        "a", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "fp"
    )
    more = (
        pairs.repartition(partitions(fps), "a", "p", "q").sortWithinPartitions("a", "p", "q", "fp")
        .mapInArrow(_walk(3, None), "kind int, a long, b long, c long")
    )
    return found.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))


def grouped(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rid, doc_id, fp, root, component_id) of rows (rid, doc_id, text)."""
    made = stored(fingerprints(rows), "fingerprints")
    # Copies meet here, added up before the exchange; what follows knows each fingerprint once.
    distinct = stored(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, block)).select(F.col("node").alias("fp"), "root")
    rooted = stored(
        distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    names = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = stored(rooted.join(names, "root").select("fp", "root", "component_id"), "named")
    return made.join(named, "fp")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id reachable) of every row."""
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("rid", F.lit(0).cast("long"))
    return grouped(rows, block).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each component, that of the smallest doc_id (null last; of repeated rows any one), all columns."""
    rows = numbered(docs, "documents", doc_id="doc_id", text="text")
    found = grouped(rows.select("rid", "doc_id", "text"), block)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))
    return only(rows, found.groupBy("root").agg(first["rid"].alias("rid")))
