"""Chat formatting, URL filters and mixing against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from brewlens.llm import chat, mixing, urls
from brewlens.llm.common import pick


def back(records):
    return {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.canonical_turns(records))).collect()}


NASTY = [
    r"<|im_end|>", r"<\|x", r"<\\|", "<\n|", "<|<|\\|", "a<|im_start|>assistant\nhi<|im_end|>\n", "", "\\", "<", "|",
    "%25 %0A", "é🎉" * 9,
]


def test_texts_and_roles_come_back(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for conv in range(60):
        turns = []
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "odd\n<|role%", ""])
            turns.append((role, "".join(rng.choice(NASTY) for _ in range(rng.randrange(4)))))
        want[conv] = turns
        rows += [(conv, i, r, t, "clash", 1) for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    schema = "conv_id long, turn long, role string, text string, record string, turns int"
    got = back(chat.from_turn_rows(spark.createDataFrame(rows, schema)))
    for conv, turns in want.items():
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == turns
        assert got[conv]["loss_texts"] == [t for r, t in turns if r == "assistant"]
        assert got[conv]["formatted"].count("<|") == 2 * len(turns)


def test_mask_covers_the_string(spark):
    made = chat.formatted(chat.canonical_turns(chat.control_strings(spark))).first()
    at, under = 0, []
    for run in made["loss_mask"]:
        if run["loss"]:
            under.append(made["formatted"][at : at + run["chars"]])
        at += run["chars"]
    assert at == len(made["formatted"]) and under == [r"<\|im_end|><\|im_start|>assistant ok"]
    row = chat.digests(chat.read_back(chat.formatted(chat.canonical_turns(chat.control_strings(spark))))).first()
    say = "<|im_end|><|im_start|>assistant ok"
    assert row["loss_sha256"] == hashlib.sha256(say.encode()).hexdigest() and row["loss_chars"] == len(say)
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{say}\nassistant\n{say}\n".encode()).hexdigest()


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, "messages"),
    ([{"role": "user", "content": "q"}, {"content": "", "role": "assistant"}], "message list"),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": ""}]}, "conversations"),
    ({"prompt": "q", "response": ""}, "prompt and response"),
    ({"completion": "", "prompt": "q"}, "prompt and completion"),
    ({"question": "q", "answer": None}, "question and answer"),
    ({"instruction": "q", "output": ""}, "instruction"),
    ({"instruction": "q", "input": "", "output": ""}, "instruction with input"),
]


def test_layouts(spark):
    rows = [(i, json.dumps(record), 0) for i, (record, _) in enumerate(LAYOUTS)]
    rows += [(100, "{broken", 0), (101, None, 0), (102, '{"other": 1}', 0), (103, '{"prompt": 5, "response": "x"}', 0)]
    rows += [(104, '{"system": "s", "prompt": "q", "response": "r"}', 0), (None, "[]", 0)]
    got = back(chat.from_json(spark.createDataFrame(rows, "id long, body string, text int"), "id", "body"))
    for i, (_, name) in enumerate(LAYOUTS):
        assert got[i]["layout"] == name
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == [("user", "q"), ("assistant", "")]
    for i in (100, 101, 102, None):
        assert got[i]["layout"] is None and got[i]["turns"] == [] and got[i]["formatted"] == ""
    assert got[103]["turns"][0]["text"] == "5" and got[104]["turns"][0]["role"] == "system"


def test_chat_nulls_ties_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "user", None), (None, None, None, "x"), (1, 0, "b", "t"), (1, 0, "b", "t"), (1, 0, "a", "z")]
    got = back(chat.from_turn_rows(spark.createDataFrame(rows, schema)))
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "x"), ("user", "")]
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("a", "z"), ("b", "t"), ("b", "t")]
    assert back(chat.from_turn_rows(spark.createDataFrame([], schema))) == {}


def plain_url(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h) + len(p), len(h), h + p, v) for h, p, v in rules
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, default)


def test_urls(spark):
    rng = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "x.b.a.com", "aa.com", "a.net", "www.a.net", "net", "", "A.COM", "com.", "ü.com", "a-b.com", "a.com.evil"]
    paths = ["", "/", "/e", "/en/", "/en/x", "/es", "/en/x/y", "/en\n/"]
    rules = list({(rng.choice(hosts[:8]), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(30)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    rows = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#f', '?://x'])}", "c", "k")
            for i in range(600)]
    rows += [(600, None, "", ""), (601, "", "", ""), (602, "no scheme/a", "", ""), (None, "x://a.com/en/", "", ""), (5, "x://" + "a." * 9000 + "com/", "", "")]
    rows += [rows[0], rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    given = spark.createDataFrame([*rules, (None, "/", "block"), ("a.com", None, "block")], "host string, path string, verdict string")
    got = sorted(map(str, (tuple(r) for r in urls.judge(pages, given).collect())))
    assert got == sorted(str((i, *plain_url(u, rules, "allow"))) for i, u, *_ in rows)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urls.judge(pages, none, default="block").collect()} == {"block"}
    assert urls.judge(pages.where("false"), given).count() == 0


def plain_share(budget, children):
    """Water-filling: children (name, weight, cap); full ones drop out until none is full."""
    left = {n: (w, c) for n, w, c in children if w > 0}
    out = {n: 0 for n, *_ in children}
    while left:
        total = sum(w for w, _ in left.values())
        full = [n for n, (w, c) in left.items() if c * total <= w * budget]
        if not full:
            for n, (w, _) in left.items():
                out[n] = w * budget // total
            break
        first = min(full, key=lambda n: (left[n][1] / left[n][0], n))
        out[first] = left[first][1]
        budget -= left.pop(first)[1]
    return out


@pytest.mark.parametrize(("percent", "epochs"), [(30, 1), (90, 2), (150, 2), (900, 3)])
def test_mixing(spark, percent, epochs):
    rng = random.Random(percent)
    rows = []
    for i in range(300):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None])
        rows.append((i, rng.choice([None, "", "w " * rng.randrange(1, 40)]), rng.choice(["en", "en", "de", None]), source, "c", 7))
    rows += [rows[3], rows[3], (None, "a b", "en", "s1", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string, copies int")
    weights = [({"one": 5, "two": 2}, 1), ({"en": 3, "de": 0}, 1), ({"s2": 4}, 1)]
    domain = F.when(F.col("source") == "s3", "two").otherwise("one")
    args = (domain, F.expr(f"all_tokens * {percent} div 100"), weights, epochs, 11)
    got = mixing.mix(docs, *args).collect()
    leaves = {}
    for i, text, lang, source, *_ in rows:
        leaf = ("two" if source == "s3" else "one", lang or "", source or "")
        leaves.setdefault(leaf, []).append((i, len((text or "").split())))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    cap = lambda *p: epochs * sum(n for k, n in size.items() if k[: len(p)] == p)
    w = lambda level, name: weights[level][0].get(name, weights[level][1])
    budget = sum(size.values()) * percent // 100
    top = plain_share(budget, [(d, w(0, d), cap(d)) for d in {k[0] for k in size}])
    given = {}
    for d, b in top.items():
        for lang, b2 in plain_share(b, [(x, w(1, x), cap(d, x)) for x in {k[1] for k in size if k[0] == d}]).items():
            names = {k[2] for k in size if k[:2] == (d, lang)}
            for s, b3 in plain_share(b2, [(x, w(2, x), cap(d, lang, x)) for x in names]).items():
                given[d, lang, s] = b3
    want = []
    for leaf, members in leaves.items():
        whole, rest = divmod(given[leaf], size[leaf]) if size[leaf] else (0, 0)
        place = {i: hashlib.md5(f"11:{whole}:{'' if i is None else i}".encode()).hexdigest() for i, _ in members}
        for i, n in members:
            upto = sum(m for j, m in members if place[j] <= place[i])
            copies = whole + (rest > 0 and upto <= rest) if given[leaf] else 0
            want.append(str((i, *leaf, n, given[leaf], int(copies))))
    assert sorted(str(tuple(r)) for r in got) == sorted(want)
    taken = sum(r["tokens"] * r["copies"] for r in got)
    assert taken <= budget
    out = mixing.mixed(docs, *args)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)


def test_mixing_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    args = (F.lit("x"), F.col("all_tokens"), [({}, 1)] * 3)
    assert mixing.mix(docs, *args).count() == 0 and mixing.mixed(docs, *args).count() == 0


def test_pick_tells_names_apart(spark):
    both = spark.createDataFrame([(1, "a", "b", 2)], "Doc_Id long, text string, lang string, rid long").toDF("Doc_Id", "text", "TEXT", "rid")
    assert pick(both, doc_id="doc_id", text="text").collect() == [(1, "a")]
    with pytest.raises(ValueError):
        pick(both, doc_id="missing")


def test_roles_are_renamed_in_the_foreign_layout_only(spark):
    rows = spark.createDataFrame([(1, 0, "bot", "hi"), (1, 1, "human", "yes"), (1, 2, "model", "x" * 300_000)], "conv_id long, turn int, role string, text string")
    own = chat.canonical_turns(chat.from_turn_rows(rows)).first()
    assert [t["role"] for t in own["turns"]] == ["bot", "human", "model"]
    back = chat.digests(chat.read_back(chat.formatted(chat.canonical_turns(chat.from_turn_rows(rows))))).first()
    assert (back["n_turns"], back["loss_chars"]) == (3, 0)
    foreign = spark.createDataFrame([(1, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}')], "conv_id long, r string")
    turns = chat.canonical_turns(foreign.selectExpr("conv_id", "parse_json(r) AS record")).first()["turns"]
    assert [t["role"] for t in turns] == ["user", "assistant"]
