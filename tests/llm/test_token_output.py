"""Token output and packing against the plain library, document by document."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brewlens.llm import packing, tokenbin
from brewlens.llm.common import scratch
from brewlens.llm.tokenizing import WordEncoder

FILE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, part int, index string, tokens string"
ODD = [
    None, "", " ", "a", "Don't stop, it's 12,5 % (ok)!! ...", "x\n\ny\tz\x0b\x0c\r q", "É…, été! ½ ÷, ×. ñ.'s",
    "<|endoftext|> and <|ENDOFTEXT|> <|startoftext|>x", "tab\x1csep\x85nel nbsp em", "é ́x ΑΣ Σ, İi",
    "日本語のテキスト。 العربية नमस्ते 🎉🎉, ok", "word " * 5000, "z" * 3000, "A.B.C a,b!c's", "İ,", "ſ. ŉ, ǅ.",
    "T\u0308x Y\u030a! J\u0323\u030c H\u0331. W\u030a t\u0308 <\u0338 =\u0338",
]


def plain(text):
    return Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_equals_library():
    rng = random.Random(3)
    alphabet = "TY\u0308\u030aabZéßñ.,!'|$ \n\t<>0123½٣x́ İΣ日🎉-_​ᲀ"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)]
    whole = Tokenizer.from_file(FILE)
    for keep in (5, 100_000):
        ids, counts = WordEncoder(FILE, keep=keep).encode(pa.array(texts))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for text, got in zip(texts, parts, strict=True):
            assert got.tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 17, t, 1, "clash", "clash") for i, t in enumerate(ODD)]
    rows += [(None, "no id", 0, "", ""), (4, "same id", 0, "", ""), (4, "same id", 0, "", "")]
    return spark.createDataFrame(rows, DOCS)


def test_files_give_every_document_back(spark, docs):
    out = scratch(spark, "test")
    tokenbin.write_tokens(docs, out, FILE, block_bytes=2000)
    got = sorted(tokenbin.read_tokens(spark, out).collect(), key=lambda r: r["start"])
    want = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None and r["text"] is not None)
    assert [r["doc_id"] for r in got] == [None, *sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None)]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    have = sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got if r["doc_id"] is not None)
    full = sorted((r["doc_id"], plain(r["text"])) for r in docs.collect() if r["doc_id"] is not None)
    assert have == full and len(want) < len(full)
    one = tokenbin.read_tokens(spark, out, doc_id=9).collect()
    assert [(r["doc_id"], r["start"]) for r in one] == [(r["doc_id"], r["start"]) for r in got if r["doc_id"] == 9]


def test_dictionary_is_checked(spark, docs):
    out = scratch(spark, "test")
    tokenbin.write_tokens(docs, out, FILE)
    spark.createDataFrame([("other", bytearray(b"x"))], "dict_hash string, content binary").write.mode(
        "overwrite"
    ).parquet(f"{out}/dictionary")
    with pytest.raises(ValueError):
        tokenbin.read_tokens(spark, out)


def test_pieces_cover_each_document_once(docs):
    pieces = packing.pack(docs, FILE, most=64).collect()
    by = {}
    for p in pieces:
        assert p["length"] & (p["length"] - 1) == 0 and p["length"] <= 64 and p["offset"] == 0
        assert len(p["tokens"]) == 4 * p["length"]
        by.setdefault(p["doc_id"], []).append(p)
    assert sorted(p["sequence_id"] for p in pieces) == list(range(len(pieces)))
    ordered = sorted(pieces, key=lambda p: p["sequence_id"])
    assert [p["length"] for p in ordered] == sorted((p["length"] for p in pieces), reverse=True)
    for row in docs.collect():
        if row["doc_id"] == 4:  # two equal rows and one more
            continue
        mine = sorted(by[row["doc_id"]], key=lambda p: p["start"])
        assert [p["start"] for p in mine] == [sum(x["length"] for x in mine[:i]) for i in range(len(mine))]
        ids = np.frombuffer(b"".join(p["tokens"] for p in mine), "<u4").tolist()
        assert ids == plain(row["text"]) and {p["doc_tokens"] for p in mine} == {len(ids)}
        assert zlib.crc32(b"".join(p["tokens"] for p in mine)) == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sum(p["length"] for p in by[4]) == sum(len(plain(r["text"])) for r in docs.collect() if r["doc_id"] == 4)


def test_empty_table(spark, docs):
    empty, out = docs.where("false"), scratch(spark, "test")
    tokenbin.write_tokens(empty, out, FILE)
    assert tokenbin.read_tokens(spark, out).count() == 0
    assert packing.pack(empty, FILE).count() == 0


def test_binary_lengths():
    assert packing.binary_lengths(2048 * 2 + 7, 2048) == [2048, 2048, 4, 2, 1]
    assert packing.binary_lengths(0, 8) == []
    with pytest.raises(ValueError):
        packing.pack(None, FILE, most=100)
