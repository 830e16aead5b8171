"""Spelling variants, shards and phrases against plain Python."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brewlens.llm import collocations, sharding, spelling
from brewlens.llm.common import scratch

CLASH = "doc_id long, text string, lang string, source string, row int, word string, shard string, n int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 1, "w", "s", 2, 3) for i, t, lang, src in rows], CLASH)


# --- spelling -----------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    partners = defaultdict(list)
    for a, b in itertools.combinations(sorted(n), 2):
        if near(a, b):
            partners[a].append(b)
            partners[b].append(a)
    form = {}
    for w, others in partners.items():
        best = min(others, key=lambda o: (-n[o], o))
        if n[best] >= 10 * n[w]:
            form[w] = best
    want = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        want[w] = (form.get(w), root, n[w], len(partners[w]), n.get(form.get(w)))
    return want


def variants_of(spark, rows):
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    got = spelling.variants(docs).collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(found) == len(got)
    return found


def test_variants(spark):
    rng = np.random.default_rng(3)
    letters = list("abcdeéÿø")
    base = ["".join(rng.choice(letters, rng.integers(7, 12))) for _ in range(30)]
    said = []
    for w in base:
        times = 1
        for _ in range(4):  # a chain of edits, each ten times rarer or so
            said += [w] * max(2, 2000 // times)
            times *= int(rng.integers(8, 14))
            i = int(rng.integers(0, len(w)))
            w = [w[:i] + w[i + 1 :], w[:i] + str(rng.choice(letters)) + w[i:], w[:i] + str(rng.choice(letters)) + w[i + 1 :]][rng.integers(0, 3)]
    said += ["Abcabca", "Ébcabca", "ab×cabca", "x" * 3000, "x" * 3000, "x" * 2999 + "y", "x" * 2999 + "y", "x" * 2999, "x" * 2999]
    rng.shuffle(said)
    rows = [(None if i == 5 else i, " ".join(said[i::40]).replace("abcabc", "ABCabc")) for i in range(40)]
    rows += [(41, None), (42, ""), (43, "short 1234 !"), (43, "short 1234 !"), (44, "q" * 90_000 + " " + "q" * 90_000), (3, rows[3][1])]
    want = plain_variants([r for r in rows if r[0] != 44])
    want["q" * 90_000] = (None, "q" * 90_000, 2, 0, None)  # its hash is not divisible by 31
    assert zlib.crc32(("44:" + "q" * 90_000).encode()) % 31
    found = variants_of(spark, rows)
    assert found == want
    assert any(f and r != f for f, r, *_ in want.values()) and any(k[3] > 1 for k in want.values())


def test_equally_frequent_near_words(spark):
    found = variants_of(spark, [(1, "beloved " * 20 + "belaved " * 20 + "belived " * 2)])
    assert found == plain_variants([(1, "beloved " * 20 + "belaved " * 20 + "belived " * 2)])


@pytest.mark.parametrize("symbols", [2, 6])
def test_neighbourhoods_are_complete(symbols):
    words = ["abcdefg", "aaaaaaa", "zzzzzzzz", "étéabcd"]
    reduced = spelling.symbol_table(symbols)

    def keys(all_words, own):
        return [(of[i], k) for key, of, _ in spelling.neighbours(all_words, symbols, own) for i, k in enumerate(key)]

    made = defaultdict(list)
    for of, key in keys(words, False):
        made[of].append(key)
    for i, w in enumerate(words):
        assert len(set(made[i])) == len(made[i])  # each neighbour once
        for p in range(len(w)):
            for c in "abcxyzÿ":
                if reduced[ord(c)] >= reduced[ord(w[p])]:  # the other direction makes the rest
                    assert keys([w[:p] + c + w[p + 1 :]], True)[0][1] in made[i]
            assert keys([w[:p] + w[p + 1 :]], True)[0][1] in made[i]


def test_no_words(spark):
    assert variants_of(spark, [(1, None), (2, "")]) == {} and spelling.variants(table(spark, [])).count() == 0


# --- shards -------------------------------------------------------------------------------------------------------


def plain_shards(rows, shards, seed):
    by = defaultdict(list)
    for i, _, _, source in rows:
        by[source or ""].append(i)
    order = []
    for source, ids in by.items():
        ids.sort(key=lambda i: hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest())
        order += [((2 * r - 1) / (2 * len(ids)), source, i) for r, i in enumerate(ids, 1)]
    order.sort(key=lambda x: x[:2])
    placed, starts = [], {}
    for at, (_, _, i) in enumerate(order):
        shard = at * shards // len(order)
        placed.append((i, shard, at - starts.setdefault(shard, at)))
    return placed


def shards_of(spark, rows, shards, seed=12):
    got = sharding.sharded(table(spark, rows), shards, seed)
    assert got.columns == ["row", "shard", "slot"]
    return [(r["row"]["doc_id"], r["shard"], r["slot"]) for r in got.collect()]


@pytest.mark.parametrize(("count", "shards", "run"), [(900, 16, 8), (37, 16, 512), (5, 16, 2), (700, 7, 1)])
def test_shards(spark, monkeypatch, count, shards, run):
    monkeypatch.setattr(sharding, "RUN", run)
    monkeypatch.setattr(sharding, "BLOCK", 16)
    rng = np.random.default_rng(count)
    names = ["hot", "a", "b", None, *[f"s{i}" for i in range(30)]]
    rows = [(i, None if i % 9 == 0 else "x" * (i % 50), "en", "hot" if rng.random() < 0.4 else names[rng.integers(0, 34)]) for i in range(count)]
    got = shards_of(spark, rows, shards)
    assert sorted(got) == sorted(plain_shards(rows, shards, 12))
    sizes = Counter(s for _, s, _ in got)
    assert {sizes[s] for s in range(shards)} <= {count // shards, -(-count // shards)}
    sources = dict((i, s or "") for i, _, _, s in rows)
    per = Counter((s, sources[i]) for i, s, _ in got)
    many = Counter(sources.values())
    for source, n in many.items():  # each shard has the mixture; a cut is at most a row a source from its fraction
        assert all(abs(per[s, source] - n / shards) <= 2 + len(many) * n / count for s in range(shards))


def test_shards_of_repeated_rows_and_nulls(spark):
    rows = [(1, "a", "en", "s")] * 20 + [(None, "b", None, None)] * 5 + [(2, None, "en", ""), (3, "long " * 50_000, "en", "s")]
    got = shards_of(spark, rows, 4)
    assert Counter(i for i, _, _ in got) == {1: 20, None: 5, 2: 1, 3: 1}
    for shard in range(4):
        slots = sorted(x for _, s, x in got if s == shard)
        assert slots == list(range(len(slots))) and 6 <= len(slots) <= 7
    assert shards_of(spark, [], 4) == []


def test_shard_files(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 3}") for i in range(50)]
    placed = sharding.sharded(table(spark, rows), 4, 1)
    path = scratch(spark, "shards")
    sharding.write_shards(placed, path)
    for shard in range(4):
        back = sharding.read_shard(spark, path, shard).select("row.doc_id", "row.text", "slot").collect()
        want = sorted((r["slot"], r["row"]["doc_id"]) for r in placed.where(f"shard = {shard}").collect())
        assert sorted((r["slot"], r["doc_id"]) for r in back) == want
        assert all(r["text"] == f"text {r['doc_id']}" for r in back)


# --- phrases ------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, first, share=100):
    f, size = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            size[lang] += len(words)
            f.update((lang, words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, words), a in found.items():
        held = any(
            100 * b >= share * a and g == lang and len(o) > len(words)
            and any(o[i : i + len(words)] == words for i in range(len(o) - len(words) + 1)) for (g, o), b in found.items()
        )
        if held:
            continue
        cuts = [(f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min((1000 * a * size[lang] // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        out[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, size[lang], -s)
        for lang, of in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(of)[:first], 1)
    )


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    common = ["the", "of", "And", "a b", "Été", "x-y", "rare"]
    fixed = ["New York city hall steps", "the the the the the the", "as soon as possible", "中文 words here"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(int(rng.integers(1, 30))):
            pick = rng.random()
            parts.append(fixed[rng.integers(0, 4)] if pick < 0.3 else f"u{rng.integers(0, 4000)}" if pick < 0.5 else common[rng.integers(0, 7)])
            parts.append(str(rng.choice([" ", "\t ", ". ", "\r\n", ";", "  "], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05])))
        rows.append((i, "".join(parts), [None, "en", "fr"][rng.integers(0, 3)], "s"))
    return rows + [(500, None, "en", "s"), (501, "", "en", "s"), (502, " \t\n.", "de", "s"), (7, rows[7][1], rows[7][2], "s")]


@pytest.mark.parametrize(("least", "first", "share", "unit"), [(3, 1000, 100, 1 << 24), (3, 7, 60, 40), (10, 20, 100, 500)])
def test_phrases(spark, monkeypatch, least, first, share, unit):
    monkeypatch.setattr(collocations, "UNIT", unit)
    rows = corpus(least + first)
    got = sorted(tuple(r) for r in collocations.phrases(table(spark, rows), least, first, share).collect())
    assert got == plain_phrases(rows, least, first, share) and got


def test_full_set_of_bits_changes_nothing(spark, monkeypatch):
    rows = corpus(5, 40)
    monkeypatch.setattr(collocations, "BITS", 1 << 11)
    got = sorted(tuple(r) for r in collocations.phrases(table(spark, rows), 3, 50).collect())
    assert got == plain_phrases(rows, 3, 50)


@pytest.mark.parametrize("most", [7, 30, 200])
@pytest.mark.parametrize("text", ["a b c d e f g h " * 40, "aaaa " * 9 + "b" * 400 + " c d e f g" * 9, "x" * 999, "a.b;c\n" * 90, " " * 500, "a b. " * 70])
def test_units_hold_every_phrase_once(text, most):
    def phrases(unit, tail):
        ids, words, joined = collocations.numbered_words(unit)
        words = words.to_pylist()
        ends = [i for i, j in enumerate(joined) if not j]
        return [
            tuple(words[ids[i + d]] for d in range(k)) for i in range(len(ids) - tail) for k in range(1, 6)
            if i + k <= len(ids) and not any(i <= e < i + k - 1 for e in ends)
        ]

    whole = text.encode()
    got = Counter(p for unit, tail in collocations.units([whole], most) for p in phrases(unit, tail))
    assert got == Counter(phrases(whole.translate(collocations._FOLD), 0))


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(7_000_000_000_000, 90_000_000_000_000, 8_000_000_000_000, 9_000_000_000_000)], "a long, n long, l long, r long")
    got = rows.select(collocations.score().alias("score")).first()["score"]
    assert got == 1000 * 7_000_000_000_000 * 90_000_000_000_000 // (8_000_000_000_000 * 9_000_000_000_000)


def test_long_text_and_no_text(spark):
    rows = [(1, "over and over again " * 40_000, "en", "s")]
    got = collocations.phrases(table(spark, rows), 100, 50).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, 100, 50)
    assert collocations.phrases(table(spark, []), 1).count() == 0
