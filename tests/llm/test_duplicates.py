"""Exact and near duplicates against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pytest
import xxhash

from brewlens.llm import exact, simhash
from brewlens.llm.common import Scratch, scratch, stored

CLASH = "doc_id long, text string, digest string, rid int, fp string, row int"


def rows_of(texts, ids=None):
    return [(ids[i] if ids else i, t, "x", 1, "y", 2) for i, t in enumerate(texts)]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


TEXTS = ["a  b", "a\tb", "a\nb ", None, "", " ", "\x0b", "é b", "é b", "x" * 40000, "a b", "a b"]


def test_exact_groups(spark):
    ids = [5, 3, 9, 8, 7, 6, None, 2, 1, 4, None, 3]
    docs = spark.createDataFrame(rows_of(TEXTS, ids), CLASH)
    got = exact.duplicates(docs, exact.DigestIndex(spark)).collect()
    groups = {}
    for i, t in zip(ids, TEXTS, strict=True):
        groups.setdefault(normal(t), []).append(i)
    want = sorted(
        (str(i), str(min((x for x in groups[normal(t)] if x is not None), default=None)), len(groups[normal(t)]),
         hashlib.sha256(normal(t).encode()).hexdigest())
        for i, t in zip(ids, TEXTS, strict=True)
    )
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_index_persists(spark):
    path = scratch(spark, "index")
    first = spark.createDataFrame(rows_of(["a", "b", "b"]), CLASH)
    assert exact.deduplicated(first, exact.DigestIndex(spark, path, 3)).count() == 2
    again = exact.DigestIndex(spark, path, 3)
    more = spark.createDataFrame(rows_of(["b", "c", "c"], [10, 11, 12]), CLASH)
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact.duplicates(more, again).collect()}
    assert got == {(10, 1, False), (11, 11, True), (12, 11, False)}
    assert again.rows().count() == 3
    plan = again.missing(more.select(exact.digest().alias("digest")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert exact.deduplicated(more, again).columns == more.columns and exact.deduplicated(more, again).count() == 0


def test_a_batch_can_be_repeated(spark):
    path = scratch(spark, "index")
    docs = spark.createDataFrame(rows_of(["a", "b", "b", "c"]), CLASH)
    exact.deduplicated(docs, exact.DigestIndex(spark, path, 3), "first")  # built and lost before it was written
    again = exact.DigestIndex(spark, path, 3)
    assert exact.deduplicated(docs, again, "first").count() == 3
    kept = [r for r in exact.duplicates(docs, again, "first").collect() if r["kept"]]
    assert len(kept) == 3 and again.rows().count() == 3
    assert exact.deduplicated(docs, again, "second").count() == 0


def test_scratch_belongs_to_its_scope(spark):
    rows = spark.range(5)
    outer = stored(rows, "outer")
    with Scratch(spark) as scope:
        inner = stored(rows, "inner")
        with Scratch(spark) as nested:
            deep = stored(rows, "deep")
    scope.release()
    assert outer.count() == 5 and deep.count() == 5
    with pytest.raises(Exception):
        inner.count()
    nested.release()


def test_reopened_with_other_shuffle_partitions(spark):
    path = scratch(spark, "index")
    docs = spark.createDataFrame(rows_of([f"text {i}" for i in range(300)]), CLASH)
    assert exact.deduplicated(docs, exact.DigestIndex(spark, path, 8)).count() == 300
    again = exact.DigestIndex(spark, path)  # the session has 4
    assert again.buckets == 8
    assert again.missing(docs.select(exact.digest().alias("digest"))).count() == 0
    assert exact.deduplicated(docs, again).count() == 0 and again.rows().count() == 300
    with pytest.raises(ValueError):
        exact.DigestIndex(spark, path, 4)
    bare = scratch(spark, "bare")
    again.rows().write.parquet(bare)
    with pytest.raises(ValueError):
        exact.DigestIndex(spark, bare)


def test_exact_empty(spark):
    empty = spark.createDataFrame([], CLASH)
    assert exact.duplicates(empty, exact.DigestIndex(spark)).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "\n", "One", "One two THREE", "a b c d", "É b\tc d e f É", "x y z w " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_fingerprint_is_spark_hash(spark):
    row = spark.sql("select xxhash64('a b c d') h").first()
    assert row["h"] % (1 << 64) == simhash.fingerprint(b"a b c d")


def test_golay_code():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    own = simhash.index(words)
    for i in range(23):  # a codeword's ball holds the word it was decoded from
        moved = simhash.index(words ^ 1 << i)
        assert ((moved == own).mean() > 0.1).all()
    codewords = {int(w) for w in range(1 << 12)}
    assert len(np.unique(simhash.index(np.arange(1 << 23)))) == len(codewords)


def test_every_error_pattern_is_met():
    for pattern in itertools.product(range(5), repeat=5):
        if sum(pattern) <= 4:
            assert any(
                pattern[a] == 0 and ((pattern[b] <= 1 and pattern[c] <= 1) or (0 in (pattern[b], pattern[c]) and pattern[b] + pattern[c] <= 2))
                for a, b, c in simhash.COMBINATIONS
            ), pattern


def test_all_links_share_a_key():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    other = one.copy()
    for i in range(len(other)):
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(bit)
    a, b = (dict.fromkeys(range(3000)) for _ in range(2))
    for side, fps in ((a, one), (b, other)):
        made, who = simhash.keys(fps)
        for k, w in zip(made.tolist(), who.tolist(), strict=True):
            side[w] = (side[w] or set()) | {k}
    assert all(a[i] & b[i] for i in range(3000))


def plain_components(ids, fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(ids[i], least.get(root(i))) for i in range(len(fps))]


def test_components(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "a", "A", "a b c"]
    for _ in range(25):
        base = list(rng.choice(words, 120))
        for _ in range(rng.integers(1, 6)):
            changed = list(base)
            for at in rng.choice(120, rng.integers(0, 4)):
                changed[at] = str(rng.choice(words))
            texts.append(" ".join(changed))
    ids = [int(x) for x in rng.permutation(len(texts) * 2)[: len(texts)]]
    ids[0] = None
    ids[3] = ids[4]
    docs = spark.createDataFrame(rows_of(texts, ids), CLASH)
    fps = [plain_fingerprint(t) for t in texts]
    want = sorted(str((d, f"{f:016x}", c)) for (d, c), f in zip(plain_components(ids, fps), fps, strict=True))
    assert len({w.split()[-1] for w in want}) < len(set(fps))
    for block in (2, simhash.BLOCK):
        got = simhash.near_duplicates(docs, block).collect()
        assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted({w.split(", ")[-1][:-1] for w in want})


def test_chain_and_large_group(spark):
    chain = [sum(0b1111 << 4 * k for k in range(i)) for i in range(12)]
    star = [1 << 63 | 1 << a | 1 << b for a in range(30) for b in range(a)]
    fps = [f - (1 << 64) if f >> 63 else f for f in [*chain, *star]]
    for block in (7, simhash.BLOCK):
        df = spark.createDataFrame([(f,) for f in fps], "fp long")
        from brewlens.llm.components import components

        found = {r["node"]: r["root"] for r in components(simhash.links(df, block)).collect()}
        roots = [found.get(f, f) for f in fps]
        assert len(set(roots[:12])) == 1 and len(set(roots[12:])) == 1


def test_near_empty(spark):
    empty = spark.createDataFrame([], CLASH)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0
