"""Every stage of the pipeline against plain Python on the smallest documents."""

import re
from collections import Counter

import corpus_pipeline
from brewlens.llm import quality, simhash
from brewlens.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 1}
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.read.parquet(_path(spark, stage(spark, docs, SF)))
        kept.append(docs.collect())
    assert all(list(rows[0].asDict()) == columns for rows in kept[:-1])
    texts = {r["doc_id"]: r["text"] for r in kept[0]}
    ids = [{r["doc_id"] for r in rows} for rows in kept]
    assert all(len(rows) == len(found) for rows, found in zip(kept[:-1], ids, strict=False))
    assert all(a >= b for a, b in zip(ids, ids[1:], strict=False))

    everywhere, good = Counter(), Counter()
    for i, t in texts.items():
        found = quality.grams(t.encode()).tolist()
        everywhere.update(found)
        if i in trusted:
            good.update(found)
    import numpy as np

    ratio = quality.weights(*[np.array([c[b] for b in range(quality.BUCKETS)], float) for c in (everywhere, good)])
    want = set()
    for i, t in texts.items():
        n, *_, repeated = quality.base(t.encode())
        if n >= 50 and 100 * repeated <= 50 * n and quality.verdict(t.encode(), ratio) >= quality.THRESHOLD:
            want.add(i)
    assert ids[1] == want

    first = {}
    for i in sorted(ids[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert ids[2] == set(first.values())

    fps = {i: simhash.fingerprint(texts[i].encode()) for i in ids[2]}
    left, least = set(fps), set()
    while left:
        front, group = [left.pop()], []
        while front:
            i = front.pop()
            group.append(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= simhash.DISTANCE}
            left -= near
            front += near
        least.add(min(group))
    assert ids[3] == least

    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) for i in ids[3])
    taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) for i in ids[4])
    assert 0.5 * words < taken <= words * 90 // 100
    whole = Counter()
    for piece in kept[5]:
        whole[piece["doc_id"]] += piece["length"]
    assert whole == {p["doc_id"]: p["doc_tokens"] for p in kept[5]} and set(whole) == ids[4]


def _path(spark, df):
    from brewlens.llm.common import shared

    path = shared(spark, "stage")
    df.write.parquet(path)
    return path


def test_run(spark):
    out = stored(corpus_pipeline.run(spark, SF), "run")
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns, an empty table; and a result opened before is not touched."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, rid int, row string, digest int, bucket int"
    good = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").orderBy("doc_id").limit(12).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "x", 2, 3) for r in good]
    long = (10_000, " ".join(r["text"] for r in good) * 20, None, None, None, 1, "x", 2, 3)
    odd = [rows[0], rows[0], (None, rows[1][1], None, None, None, None, None, None, None), long, long, (None, None, None, None, None, None, None, None, None),
           (10_001, "", "en", "src1", 0, 0, "", 0, 0), (10_002, " \n\t", "en", "src1", 0, 0, "", 0, 0)]
    opened = simhash.near_duplicates(spark.createDataFrame(rows, schema))
    for given in (rows + odd, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = docs.count()
            docs = spark.read.parquet(_path(spark, stage(spark, docs, SF)))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")] and docs.count() <= before
        texts = [r["text"] for r in docs.collect()]
        assert len(texts) == len(set(texts)) and None not in texts and "" not in texts
        pieces = spark.read.parquet(_path(spark, corpus_pipeline.STAGES[-1][1](spark, docs, SF)))
        assert (pieces.count() > 0) == bool(texts) == bool(given)
    assert opened.count() == len(rows)
