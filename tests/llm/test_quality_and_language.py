"""Quality rules and language profiles against plain counting and held-out labels."""

import re
from collections import Counter

import numpy as np

from brewlens.llm import langid, quality

DOCS = "doc_id long, text string, lang string, trusted boolean, score double"
TEXTS = [
    None, "", " \n\t", "abc", "a b c a b c", "one two\none two\n \n\none  two", "#*$ %&|<> é\x85é x", "a\x1cb c\x0bd",
    "The same line. " * 40, " ".join(f"w{i}" for i in range(60)), "日本 語 " * 30 + " ".join(map(str, range(400))),
    " ".join(f"long{i % 7000}" for i in range(20000)),
]


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_counts():
    for text in TEXTS:
        assert quality.base((text or "").encode()) == plain_base(text), text


def plain_buckets(text):
    data = (text or "").encode()
    return [(int.from_bytes(data[i : i + 4], "little") * 2654435761 % 2**32) >> 16 for i in range(len(data) - 3)]


def test_scores_and_verdicts(spark):
    good = [" ".join(f"fair{(i * k) % 97}" for i in range(80)) for k in range(1, 20)]
    bad = [" ".join(f"{i * k % 89}$$$|" for i in range(80)) for k in range(1, 6)]
    texts = TEXTS + good + bad
    docs = spark.createDataFrame([(i, t, "x", True, 0.0) for i, t in enumerate(texts)] + [(None, "q", "", True, 0.0)], DOCS)
    marked = [(len(TEXTS) + i, 1, 0) for i in range(0, len(good), 2)] + [(0, 0, 1), (None, 1, 1), (9, 1, 0), (9, None, 0)]
    labels = spark.createDataFrame(marked, "doc_id long, quality int, toxic int")
    ratio = quality.fit(docs, labels)
    everywhere, trusted = Counter(), Counter()
    for i, t in enumerate([*texts, "q"]):
        everywhere.update(plain_buckets(t))
        if len(TEXTS) <= i < len(TEXTS) + len(good) and (i - len(TEXTS)) % 2 == 0:
            trusted.update(plain_buckets(t))
    counts = [np.array([c[b] for b in range(quality.BUCKETS)], dtype=float) for c in (everywhere, trusted)]
    assert np.allclose(ratio, quality.weights(*counts))
    got = {r["doc_id"]: r for r in quality.judge(docs, ratio).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeated = plain_base(t)
        failed = n < 50 or 100 * repeated > 50 * n
        buckets = plain_buckets(t)
        score = sum(ratio[b] for b in buckets) / len(buckets) if buckets else 0.0
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeated)
        assert r["base_failed"] == failed and abs(r["score"] - score) < 1e-9
        assert r["kept"] == (not failed and score >= quality.THRESHOLD)
    assert all(got[len(TEXTS) + i]["kept"] for i in range(len(good)))
    assert not any(got[len(TEXTS) + len(good) + i]["kept"] for i in range(len(bad)))
    kept = quality.passing(docs, ratio)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"])


def test_model_grows_with_the_four_grams(spark):
    """Ever more scripts: unlike four-grams must not fill the buckets, or junk shares those of good text."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 2000))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "x", True, 0.0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    ratio = quality.fit(docs, labels)
    everywhere, trusted = Counter(), Counter()
    for i, t in enumerate(texts):
        data = t.encode()
        found = [data[k : k + 4] for k in range(len(data) - 3)]
        everywhere.update(found)
        trusted.update(found if i < 20 else [])
    assert len(everywhere) > quality.BUCKETS and len(ratio) >= 2 * len(everywhere)
    assert len(ratio) & (len(ratio) - 1) == 0
    used = {int(quality.grams(g, len(ratio))[0]) for g in everywhere}
    assert len(used) > 0.75 * len(everywhere)
    counts = np.zeros((2, len(ratio)))
    for k, side in enumerate((everywhere, trusted)):
        for g, n in side.items():
            counts[k, quality.grams(g, len(ratio))[0]] += n
    assert np.allclose(ratio, quality.weights(*counts))


def test_nothing_trusted_and_empty(spark):
    empty, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int")
    assert not quality.fit(empty, labels).any()
    assert quality.judge(empty, quality.fit(empty, labels)).count() == 0
    assert langid.learn(empty) == {} and langid.predict(empty, {}).count() == 0


def plain_profile(texts):
    count = Counter()
    for t in texts:
        s = " " + re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0].isalpha() else " ", t.lower(), flags=re.S) + " "
        s = re.sub(" +", " ", s)
        for n in range(1, 5):
            for i in range(len(s) - n + 1):
                if s[i : i + n] != " ":
                    count[s[i : i + n]] += 1

    def order(g):
        value = 0
        for c in g:
            value = value << 16 | ord(c)
        return -count[g], value

    return sorted(count, key=order)[: langid.PROFILE]


def test_profiles_and_distances(spark):
    say = {"a": ["the cat, the dog & the end", "They then thought."], "b": ["el gato y el perro", "él y ella, ¡ellos!"]}
    docs = spark.createDataFrame([(i, t, lang, True, 0.0) for lang, ts in say.items() for i, t in enumerate(ts * 3)], DOCS)
    learned = langid.learn(docs)
    for lang, texts in say.items():
        codes = []
        for g in plain_profile(texts * 3):
            value = 0
            for c in g:
                value = value << 16 | ord(c)
            codes.append(value)
        assert learned[lang].tolist() == codes
    ask = ["the thing", "el y", None, "", "12 34 !", "x"]
    got = langid.predict(spark.createDataFrame([(i, t, None, False, 1.0) for i, t in enumerate(ask)], DOCS), learned)
    for r in got.collect():
        text = ask[r["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own = plain_profile([text])
        far = {}
        for lang, texts in say.items():
            ranks = {g: i for i, g in enumerate(plain_profile(texts * 3))}
            far[lang] = sum(abs(i - ranks[g]) if g in ranks else langid.PROFILE for i, g in enumerate(own))
        best = min(sorted(far), key=far.get)
        assert r["lang_pred"] == best and abs(r["score"] - (1 - far[best] / (langid.PROFILE * len(own)))) < 1e-12


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = langid.learn(docs.where(langid.fold() != 2))
    held = docs.where(langid.fold() == 2).join(langid.predict(docs, profiles), "doc_id")
    right = held.where("lang = lang_pred").count() / held.count()
    assert right >= 0.95, right
