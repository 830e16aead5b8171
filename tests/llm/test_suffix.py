"""Repeated passages against windows of all texts."""

import random
import re
from collections import defaultdict

import pytest

from brewlens.llm import suffix
from brewlens.llm.common import Scratch

N = suffix.MIN_WORDS


def plain(docs):
    """Words of each row (by its place) that lie in a window of N words found twice."""
    places = defaultdict(list)
    for k, (_, text) in enumerate(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(words) - N + 1):
            places[" ".join(words[i : i + N])].append((k, i))
    hit = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                hit[k].update(range(i, i + N))
    return {k: v for k, v in hit.items() if v}


def covered(rows):
    hit = defaultdict(set)
    for r in rows:
        hit[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
    return hit


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    passages = [words(rng, n) for n in (49, 50, 51, 80, 300)]
    texts = [None, "", " ", "short text", words(rng, 49), words(rng, 60)]
    for p in passages:
        for _ in range(4):
            texts.append(" ".join([words(rng, rng.randrange(40)), p, words(rng, rng.randrange(40))]))
    texts += [f"{passages[3]}  {words(rng, 5)}\n{passages[3]}", passages[2], "a " * 200, "The\tsame " * 40 + "end"]
    texts += [texts[-3], texts[-3] + " ", words(rng, 3000) + passages[4] * 3 + words(rng, 9000), "é " + passages[3] + "\x85"]
    return [(i * 7 % 101, t) for i, t in enumerate(texts)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "c", 3) for i, t in docs], "doc_id long, text string, id string, tie int")


def test_every_window_keeps_a_suffix():
    rng = random.Random(1)
    text = words(rng, 700).encode().split()
    at, _ = suffix.retained(text)
    assert all(any(i <= p < i + suffix.REACH for p in at) for i in range(len(text) - N + 1))
    assert [len(suffix.retained(text[:n])[0]) for n in (0, 49, 50)] == [0, 0, 1]


def test_same_as_windows(spark, docs):
    got = covered(suffix.repeats(frame(spark, docs)).collect())
    assert got == {docs[k][0]: v for k, v in plain(docs).items()}


def test_matches_are_real(spark, docs):
    by = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    for r in suffix.repeats(frame(spark, docs)).collect():
        other = by[r["match_doc_id"]][r["match_start"] :][: suffix.GRAM]
        text = " ".join(by[r["doc_id"]][r["start"] : r["start"] + r["n_words"]])
        assert " ".join(other) in text


def test_recall_on_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    want = {rows[k][0]: v for k, v in plain(rows).items()}
    got = covered(suffix.repeats(table).collect())
    assert all(v <= want[k] for k, v in got.items())
    total = sum(map(len, want.values()))
    assert sum(len(want[k] & got[k]) for k in want) >= 0.999 * total > 0
    assert set(got) == set(want)


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_templates_with_a_common_line(spark, seed):
    """Sixty words: one of ten beginnings, a line that all share, one of ten ends; the sides of each differ freely."""
    rng = random.Random(seed)
    line = words(rng, 20)
    heads, tails = ([words(rng, 20) for _ in range(10)] for _ in range(2))
    texts = [
        " ".join([words(rng, rng.randrange(5, 40)), h, line, t, words(rng, rng.randrange(5, 40))])
        for h in heads for t in tails for _ in range(4)
    ]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    assert covered(suffix.repeats(frame(spark, docs)).collect()) == plain(docs)


def test_neighbours_in_different_ranges(spark, docs, monkeypatch):
    """Almost every suffix and every key is the first or the last of its range."""
    monkeypatch.setattr(suffix, "partitions", lambda _: 40)
    rng = random.Random(5)
    line = words(rng, 20)
    sides = [(words(rng, 20), words(rng, 20)) for _ in range(3)]
    more = [" ".join([h, line, t, words(rng, 9)]) for h, _ in sides for _, t in sides for _ in range(2)]
    rows = docs + [(200 + i, t) for i, t in enumerate(more)]
    got = covered(suffix.repeats(frame(spark, rows)).collect())
    assert got == {rows[k][0]: v for k, v in plain(rows).items()}


def test_repeated_rows_null_ids_and_empty(spark):
    rng = random.Random(2)
    text = words(rng, 70)
    rows = frame(spark, [(3, text), (3, text), (None, "x " + text), (4, words(rng, 70))])
    got = covered(suffix.repeats(rows).collect())
    assert got == {3: set(range(70)), None: set(range(1, 71))}
    assert suffix.repeats(rows.where("false")).count() == 0


def test_few_rows_are_few_files(spark, docs):
    """Ordered exchanges of few rows are one task, whatever the session's number, and no table is stored to number its rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        with Scratch(spark) as scope:
            got = covered(suffix.repeats(frame(spark, docs)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = {p: len(spark.read.parquet(p).inputFiles()) for p in scope.paths}
    scope.release()
    assert got == {docs[k][0]: v for k, v in plain(docs).items()}
    assert len(files) <= 11
    assert all(n <= 1 for p, n in files.items() if "/neighbours-" in p or "/linked-" in p)


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix, "TASK_ROWS", 10)
    assert [suffix.partitions(spark.range(n)) for n in (0, 9, 10, 25, 1000)] == [1, 1, 2, 3, 4]
