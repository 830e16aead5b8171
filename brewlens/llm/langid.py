"""Language of a text by rank-order profiles.

A profile is a list of the most frequent n-grams (one to four characters of the lower-cased text, every run of
other characters than letters counting as one blank). A text's own most frequent n-grams are compared with each
language's profile: each adds the distance between its two ranks, or the longest distance if the profile lacks
it. The language with the least sum wins, the first in alphabetical order on a tie; the score is one less the sum
over the largest possible sum.

An n-gram is four 16-bit units, so letters outside the basic plane count by their low 16 bits.

Defined cases: ``und`` and score 0 for null text, for text without a letter, and if no language was learned;
null ids count as the empty text in folds; rows that repeat are learned and judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brewlens.llm.common import pick, slices

LONGEST = 4
#: N-grams of a profile. With the number of languages it bounds all that the driver holds.
PROFILE = 400
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters, as a table."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def units(text: str) -> np.ndarray:
    """Letters of the lower-cased text as 16-bit units, one blank around and between its words; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.uint64)
    points = np.where(letter, points & 0xFFFF, 0x20)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of several blanks
    points = points[keep]
    ends = [0x20]
    return np.concatenate([ends, points, ends if points[-1] != 0x20 else []]).astype(np.uint64)


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams but single blanks."""
    u = units(text)
    out, code = [], np.zeros(len(u), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        if len(u) < n:
            break
        code = (code[: len(u) - n + 1] << np.uint64(16)) | u[n - 1 :]
        out.append(code[code != 0x20] if n == 1 else code)
    return np.concatenate(out) if out else u


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[first], np.diff(np.concatenate([first, [len(codes)]]))


def top(codes: np.ndarray, times: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order; equal counts in order of the code."""
    if len(codes) > 4 * most:  # only those that can be among them need sorting
        least = np.partition(times, len(times) - most)[len(times) - most]
        codes, times = codes[times >= least], times[times >= least]
    return codes[np.lexsort((codes, -times))[:most]]


def fold(doc_id: str = "doc_id", folds: int = 4) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def learn(docs: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of all languages of ``docs`` (text, lang), counted over all of their texts.

    Each task adds up counts of its own before the exchange; the driver gets ``profile`` n-grams a language.
    """
    rows = pick(docs, text="text", lang="lang").where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        waiting = 0

        def flush(lang: str) -> tuple[np.ndarray, np.ndarray]:
            codes = np.concatenate([c for c, _ in held[lang]])
            times = np.concatenate([t for _, t in held[lang]])
            order = np.argsort(codes, kind="stable")
            codes, times = codes[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            return codes[first], np.add.reduceat(times, first)

        def send(lang: str, codes: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(times, pa.int64())],
                ["lang", "gram", "times"],
            )

        for batch in batches:
            for part in slices(batch, most=1 << 20):
                by: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    if len(found := grams(text)):
                        by.setdefault(lang, []).append(found)
                for lang, found in by.items():
                    held.setdefault(lang, []).append(counted(np.concatenate(found)))
                    waiting += len(held[lang][-1][0])
                if waiting > 4_000_000:
                    waiting = 0
                    for lang in list(held):
                        held[lang] = [flush(lang)]
                        waiting += len(held[lang][0][0])
                    if waiting > 2_000_000:
                        for lang in held:
                            yield send(lang, *held[lang][0])
                        held, waiting = {}, 0
        for lang in held:
            yield send(lang, *flush(lang))

    sums = (
        rows.mapInArrow(count, "lang string, gram long, times long")
        .groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    )
    # As the tie rule sorts unsigned codes, signed ones are shifted into the same order.
    unsigned = F.col("gram").bitwiseXOR(F.lit(-(1 << 63)))
    best = Window.partitionBy("lang").orderBy(F.desc("times"), unsigned)
    chosen = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= profile)
    found: dict[str, dict[int, int]] = {}
    for r in chosen.select("lang", "gram", "rank").collect():  # bounded: languages times the profile's length
        found.setdefault(r["lang"], {})[r["rank"]] = r["gram"]
    return {
        lang: np.array([ranks[k] for k in sorted(ranks)], dtype=np.int64).view(np.uint64)
        for lang, ranks in sorted(found.items())
    }


class Matcher:
    """Out-of-place distances of one text to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], profile: int = PROFILE):
        self.langs = sorted(profiles)
        self.profile = profile
        self.known = np.unique(np.concatenate([profiles[x] for x in self.langs])) if self.langs else np.zeros(0, "u8")
        self.rank = np.full((len(self.langs), len(self.known)), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.known, profiles[lang])] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes = grams(text) if text else ()
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = top(*counted(codes), self.profile)
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        ranks = np.where(self.known[at] == own, self.rank[:, at], -1)
        far = np.where(ranks < 0, self.profile, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(far.argmin())
        return self.langs[best], 1.0 - float(far[best]) / (self.profile * len(own))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], profile: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score of every row; only the text is looked at."""
    rows = pick(docs, doc_id="doc_id", text="text")

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(profiles, profile)
        for batch in batches:
            for part in slices(batch):
                found = [match(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x[0] for x in found], pa.string()),
                     pa.array([x[1] for x in found], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return rows.mapInArrow(guess, "doc_id long, lang_pred string, score double")
