"""One query per operator over the given tables, with production parameters, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brewlens.llm import (
    chat, collocations, exact, langid, mixing, packing, quality, sharding, simhash, spelling, suffix, tokenbin, urls,
)
from brewlens.llm.common import scratch, stored
from brewlens.session import ship_package

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    tokenbin.write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path(VOCABULARY))
    return tokenbin.read_tokens(spark, out).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "bucket",
    )


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold() == 2
    profiles = langid.learn(docs.where(~held_out))
    folds = docs.select("doc_id", "text")
    return langid.predict(folds, profiles).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the smaller ids first, through one index that is opened again; sizes are those of both."""
    docs, half = table(spark, sf_dir, "documents"), F.percentile_approx("doc_id", 0.5, 1000)
    early = F.coalesce(F.col("doc_id") <= docs.select(half).first()[0], F.lit(False))
    index = exact.DigestIndex(spark)
    one = exact.duplicates(docs.where(early), index)
    two = exact.duplicates(docs.where(~early), exact.DigestIndex(spark, index.path))
    rows = stored(one.unionByName(two).drop("group_size"), "batches")
    sizes = stored(rows.groupBy("text_sha256").agg(F.count("*").alias("group_size")), "sizes")
    return rows.join(sizes, "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat.from_turn_rows(table(spark, sf_dir, "conversations")).unionByName(chat.control_strings(spark))
    return chat.digests(chat.read_back(chat.formatted(chat.canonical_turns(records))))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(24 + length(role) + length(text)
      + len(regexp_extract_all(text, '<\\*\|'))
      + 2 * len(regexp_extract_all(role, '[%<\n]'))) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars
FROM g
"""

#: host, path, verdict.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


URL_SQL = f"""
WITH r(rhost, rpath, said) AS (VALUES {', '.join(str(x) for x in RULES)}), a AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a
), u AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b
), m AS (
  SELECT host, path, rhost || rpath AS rule, said,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM (SELECT DISTINCT host, path FROM u) JOIN r
    ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
)
SELECT page_id, u.host, u.path, rule, coalesce(said, 'allow') AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path AND n = 1
"""

#: The corpus tree: sources of one digit count as web, the others as reference; weights of each level.
DOMAIN = "if(length(source) <= 4, 'web', 'reference')"
WEIGHTS = [({"web": 60, "reference": 40}, 1), ({"en": 70}, 10), ({}, 1)]
BUDGET = "all_tokens * 90 div 100"
EPOCHS, MIX_SEED = 3, 20


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(
        table(spark, sf_dir, "documents"), F.expr(DOMAIN), F.expr(BUDGET), WEIGHTS, EPOCHS, MIX_SEED
    )


def _share_sql(children: str, parent: str, child: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""(
  SELECT *, CAST(CASE WHEN filled THEN cap WHEN w > 0 THEN CAST(w AS HUGEINT) * (budget - spent) // others ELSE 0 END AS BIGINT) AS given
  FROM (SELECT *, sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({by}) AS spent,
          sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({by}) AS others
    FROM (SELECT *, w > 0 AND CAST(cap AS HUGEINT) * CAST(open_w AS HUGEINT) <= CAST(w AS HUGEINT) * (budget - used) AS filled
      FROM (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
              sum(w) OVER ({by} ORDER BY cap / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
        FROM {children})))
)"""


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN length(source) <= 4 THEN 'web' ELSE 'reference' END AS domain, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents
), l AS (SELECT domain, lang, source, sum(tokens) AS tokens, {EPOCHS} * sum(tokens) AS cap, 1 AS w FROM d GROUP BY ALL
), a AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'web' THEN 60 ELSE 40 END AS w,
    (SELECT sum(tokens) FROM d) * 90 // 100 AS budget FROM l GROUP BY domain
), ga AS {_share_sql('a', '', 'domain')}, b AS (
  SELECT domain, lang, sum(l.cap) AS cap, CASE lang WHEN 'en' THEN 70 ELSE 10 END AS w, any_value(given) AS budget
  FROM l JOIN ga USING (domain) GROUP BY domain, lang
), gb AS {_share_sql('b', 'domain', 'lang')}, c AS (
  SELECT l.*, given AS budget FROM l JOIN (SELECT domain, lang, given FROM gb) USING (domain, lang)
), gc AS {_share_sql('c', 'domain, lang', 'source')}, p AS (
  SELECT d.*, given, CASE WHEN gc.tokens > 0 THEN given // gc.tokens ELSE 0 END AS whole,
    CASE WHEN gc.tokens > 0 THEN given % gc.tokens ELSE 0 END AS rest
  FROM d JOIN gc USING (domain, lang, source)
), q AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{MIX_SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p
)
SELECT doc_id, domain, lang, source, tokens, given,
  CAST(CASE WHEN given > 0 THEN whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS copies
FROM q
"""

EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


SHARDS, SHARD_SEED = 16, 12


def shard_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and checksum are taken from the texts as they lie in the shards."""
    said = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return sharding.sharded(table(spark, sf_dir, "documents"), SHARDS, SHARD_SEED).select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(said) + 1).cast("long").alias("size"),
        F.crc32(said).alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


#: A-Z in lower case, as DuckDB says it; and CRC32 of a list of bytes with its table, built by the rule of its polynomial.
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CRC_TABLE_SQL = """c(tab) AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda v, step: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))
)"""
CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({})), '..'),
    lambda h: CAST('0x' || h AS BIGINT))), lambda v, b: xor(v >> 8, tab[(xor(v, b) & 255) + 1])), 4294967295)"""

SPELLING_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL}, o AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), r AS (
  SELECT doc_id, run, count(*) AS times FROM o WHERE length(run) >= {spelling.LEAST_LETTERS} GROUP BY ALL
), h AS (
  SELECT run, times, {CRC_SQL.format("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r, c
), v AS (
  SELECT CASE WHEN h % {spelling.DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
    CAST(sum(times) AS BIGINT) AS n FROM h GROUP BY 1
), w AS (
  SELECT word, n FROM v WHERE length(word) >= {spelling.LEAST_LETTERS} AND n >= {spelling.LEAST_TIMES}
), s AS (
  SELECT word, n, i, length(word) AS letters, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), one AS (
  SELECT a.word AS x, b.word AS y FROM s a JOIN s b ON a.letters = b.letters AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word FROM s JOIN w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM s JOIN w ON s.rest = w.word
), g AS (
  SELECT x, y, w.n AS yn, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY w.n DESC, y) AS place
  FROM one JOIN w ON y = w.word
), f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN yn >= {spelling.RATIO} * n THEN y END AS form,
    CASE WHEN yn >= {spelling.RATIO} * n THEN yn END AS form_n
  FROM w LEFT JOIN g ON word = x AND place = 1
), walk(word, here) AS (
  SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON here = f.word WHERE f.form IS NOT NULL
), e AS (SELECT walk.word, here FROM walk JOIN f ON here = f.word WHERE f.form IS NULL)
SELECT f.word, form, here AS root, n, n_near, form_n FROM f JOIN e ON f.word = e.word
"""

SHARD_SQL = f"""
WITH {CRC_TABLE_SQL}, d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text,
    md5('{SHARD_SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), r AS (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY key) AS place, count(*) OVER (PARTITION BY source) AS n FROM d
), p AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY CAST(2 * place - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), source) - 1 AS i,
    count(*) OVER () AS total FROM r
), q AS (SELECT *, i * {SHARDS} // total AS shard FROM p)
SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, {CRC_SQL.format('text')} AS text_crc32, '{sharding.LAW}' AS law,
  CAST(shard AS INTEGER) AS shard, i - (shard * total + {SHARDS - 1}) // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM q, c
"""

PHRASES_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER_SQL.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), g AS (
  SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i
  FROM (SELECT lang, words, unnest(range(1, 6)) AS k FROM w) WHERE k <= len(words)
), f AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL
), size AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), found AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 100
), kept AS (
  SELECT * FROM found s WHERE NOT EXISTS (SELECT 1 FROM found l WHERE l.lang = s.lang AND l.k > s.k AND 100 * l.a >= 100 * s.a
    AND contains(' ' || l.phrase || ' ', ' ' || s.phrase || ' '))
), cut AS (
  SELECT lang, phrase, a, c, array_to_string(words[1:c], ' ') AS one, array_to_string(words[c + 1:k], ' ') AS two
  FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)
), scored AS (
  SELECT x.lang, x.phrase, x.a, o.f AS l, t.f AS r, n,
    CAST(CAST(1000 AS HUGEINT) * x.a * n // (CAST(o.f AS HUGEINT) * t.f) AS BIGINT) AS score, c
  FROM cut x JOIN f o ON o.lang = x.lang AND o.phrase = x.one JOIN f t ON t.lang = x.lang AND t.phrase = x.two
    JOIN size ON size.lang = x.lang
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM scored
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM best WHERE place = 1
)
SELECT * FROM ranked WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": chats,
        "op2_urls": url_filters,
        "op3_token_ids": token_ids,
        "op4_language": languages,
        "op5_quality": quality_rules,
        "op6_packing": packed_pieces,
        "op7_simhash": near_duplicates,
        "op8_exact_dedup": exact_duplicates,
        "op9_mixing": mixture,
        "op10_suffix": repeated_passages,
        "op11_spelling": spelling_variants,
        "op12_sharding": shard_places,
        "op13_phrases": phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat": CHAT_SQL,
        "op2_urls": URL_SQL,
        "op8_exact_dedup": EXACT_SQL,
        "op9_mixing": MIX_SQL,
        "op11_spelling": SPELLING_SQL,
        "op12_sharding": SHARD_SQL,
        "op13_phrases": PHRASES_SQL,
    }
