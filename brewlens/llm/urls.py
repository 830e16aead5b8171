"""URL filters by a sort-merge range join.

A host is written with its labels reversed and a dot behind each (``com.example.www.``), so a rule's host stands for
the interval of all keys that begin with its own key. Urls and rules are dealt out in ranges of the key; a rule goes
to every range its interval meets. Each range is swept in order with a stack of the rules whose interval is open;
those are nested. Of the open rules, the longest whose path begins the url's path decides.

A range's bounds come from a seeded draw of the keys (at most ``DRAWN`` for each range); they steer only the balance.
Urls of one host are spread over ranges by path and page, so a frequent host is no hot key.

Defined cases: a null url and one without ``://`` have empty host and path; a url no rule fits gets the default
verdict and a null rule; of rules equal in host and path ``block`` wins; rules with null host, path or verdict are
dropped; a rule with an empty host fits every host; equally long rules of different hosts: the longer host wins;
repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brewlens.llm.common import partitions, pick

#: Keys that a range's bounds are drawn from, and how many characters of each.
DRAWN, DRAWN_CHARS = 20, 256


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def key(host: Column) -> Column:
    labels = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(labels)


def _sweep(default: str):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: int | None = None
        stack: list[tuple[str, str, dict[str, str], list[int]]] = []  # key, host, verdict by path, path lengths
        for batch in batches:
            out: list[tuple] = []
            for p, k, rule, page, host, path, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    part, stack = p, []
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if rule:
                    if not stack or stack[-1][0] != k:
                        stack.append((k, host, {}, []))
                    _, _, by_path, sizes = stack[-1]
                    if by_path.get(path) != "block":
                        by_path[path] = said
                    if len(path) not in sizes:
                        sizes.append(len(path))
                        sizes.sort(reverse=True)
                    continue
                best: tuple = ()
                for k2, host2, by_path, sizes in stack:
                    for n in sizes:
                        if n <= len(path) and path[:n] in by_path:
                            best = max(best, (len(host2) + n, len(host2), host2 + path[:n], by_path[path[:n]]))
                            break
                out.append((page, host, path, *(best[2:] or (None, default))))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = [pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return sweep


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every url; rules have host, path and verdict."""
    host, path = host_and_path(F.col("url"))
    urls = pick(pages, page_id="page_id", url="url").select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", key(F.col("host")))
    # Behind the key comes a character below all others, so a host stands before its subdomains.
    place = F.concat_ws("\u0001", "key", "path", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    urls = urls.withColumn("place", place)

    ranges = partitions(pages)
    share = min(1.0, DRAWN * ranges / max(1, pages.count()))  # the count comes from file footers
    drawn = urls.sample(share, seed=7).select(F.substring("place", 1, DRAWN_CHARS).alias("p"))
    keys = np.array(sorted(r["p"] for r in drawn.collect()), dtype=object)
    bounds = keys[np.linspace(0, len(keys), ranges + 1).astype(int)[1:-1].clip(max=max(0, len(keys) - 1))] if len(keys) else keys

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(dtype=object), side="right"), dtype="int32")

    dealt = urls.select(
        range_of("place").alias("range"), "place", "key", F.lit(False).alias("is_rule"), "page_id", "host", "path",
        F.lit(None).cast("string").alias("said"),
    )
    laid = pick(rules, host="host", path="path", verdict="verdict").dropna().select(
        lower_ascii(F.col("host")).alias("host"), "path", F.col("verdict").alias("said")
    ).withColumn("key", key(F.col("host")))
    # The keys of an interval are those from its own to the same with a last character one higher ('.' to '/').
    last = F.when(F.col("key") == "", F.lit("\U0010ffff")).otherwise(
        F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    )
    copies = laid.withColumn("range", F.explode(F.sequence(range_of("key"), range_of(last)))).select(
        "range", F.col("key").alias("place"), "key", F.lit(True).alias("is_rule"),
        F.lit(None).cast("long").alias("page_id"), "host", "path", "said",
    )
    swept = (
        dealt.unionByName(copies).repartitionById(ranges, "range")
        .sortWithinPartitions("range", "place", F.desc("is_rule"))
        .select("range", "key", "is_rule", "page_id", "host", "path", "said")
    )
    return swept.mapInArrow(
        _sweep(default), "page_id long, host string, path string, rule string, verdict string"
    )
