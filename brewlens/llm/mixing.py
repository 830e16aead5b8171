"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

A token budget is handed down a tree of domain, language and source. At each node the children share it by weight; a
child whose whole subtree can supply less than its share gets what it has, and the rest is shared again among its
siblings. As a node never receives more than its subtree supplies, what siblings cannot take is shared among the
node's own siblings instead: siblings come before ancestors. A leaf supplies its tokens ``epochs`` times at most.

A leaf's budget buys whole epochs and a prefix of one more. The order of an epoch is that of a hash of seed, epoch and
doc_id; the prefix ends before the first document that would exceed the budget. It is found without sorting a leaf:
tokens are summed by the hash's first digits, the group where the budget ends by the next ones, and so on; only the
last group is looked at by document.

Tokens are words. Shares are whole numbers, rounded down.

Defined cases: null text has no tokens, null domain, language or source count as the empty name; rows of a leaf that
share a ``doc_id`` have one place in the order and are taken together or not at all; a leaf without tokens, or of
weight 0, is not taken; if all subtrees are used up the budget is not spent; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brewlens.llm.common import packed, pick, stored, text_of

LEAF = ["domain", "lang", "source"]
#: Leading hex digits of the hash by which tokens are summed, coarse to fine: a step looks at 256 groups of a leaf,
#: and the last leaves one document in 16 million to be ordered.
DIGITS = (2, 4, 6)


def words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weight(of: str, table: dict[str, int], default: int) -> Column:
    """A declared weight of each name, else the default."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else None
    return (F.coalesce(F.element_at(known, F.col(of)), F.lit(default)) if table else F.lit(default)).cast("long")


def _share(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``given``: what each child (weight w, supply cap) gets of its parent's budget."""
    order = Window.partitionBy(*parent).orderBy(F.expr("if(w > 0, cap / w, double('inf'))"), child)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    wide = "decimal(19,0)"
    judged = children.select(
        "*", F.coalesce(F.sum("cap").over(ahead), F.lit(0)).alias("used"), F.sum("w").over(rest).alias("open")
    ).withColumn(
        "full", F.expr(f"w > 0 and cast(cap as {wide}) * cast(open as {wide}) <= cast(w as {wide}) * cast(budget - used as {wide})")
    )
    whole = Window.partitionBy(*parent)
    pooled = judged.select(
        "*", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole).alias("spent"),
        F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole).alias("others"),
    )
    given = F.expr(
        f"if(full, cap, if(w > 0, cast(w as {wide}) * cast(budget - spent as {wide}) div cast(others as {wide}), 0))"
    )
    return pooled.withColumn("given", given.cast("long")).drop("used", "open", "full", "spent", "others")


def budgets(
    supply: DataFrame, budget: Column, weights: list[tuple[dict[str, int], int]], epochs: int
) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``given``. Window partitions hold the children of one node."""
    level = supply.withColumn("cap", F.col("tokens") * epochs)
    tops = level.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    tops = tops.withColumn("w", weight("domain", *weights[0]))
    total = F.sum("tokens").over(Window.partitionBy())  # one row a domain
    tops = tops.withColumn("all_tokens", total).withColumn("budget", budget)
    given = _share(tops, [], "domain")
    mids = level.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", weight("lang", *weights[1]))
    mids = mids.join(given.select("domain", F.col("given").alias("budget")), "domain")
    given = _share(mids, ["domain"], "lang")
    low = level.withColumn("w", weight("source", *weights[2]))
    low = low.join(given.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"])
    return _share(low, ["domain", "lang"], "source").select(*LEAF, "tokens", "given")


def _place(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def cuts(
    rows: DataFrame, budget: Column, weights: list[tuple[dict[str, int], int]], epochs: int, seed: int
) -> DataFrame:
    """Per leaf: given, whole (epochs), and where its prefix ends: ``upto`` (hash, included) or ``below`` (excluded)."""
    supply = rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    leaves = stored(
        budgets(supply, budget, weights, epochs).select(
            *LEAF, "given", F.expr("if(tokens > 0, given div tokens, 0)").alias("whole"),
            F.expr("if(tokens > 0, given % tokens, 0)").alias("rest"),
        ),
        "leaves",
    )
    keyed = rows.join(leaves, LEAF).withColumn("place", _place(seed))
    ended: DataFrame | None = None
    for digits in DIGITS:
        inside = keyed.withColumn("before", F.lit(0).cast("long")) if ended is None else _inside(keyed, ended)
        heads = inside.groupBy(*LEAF, "rest", "before", F.substring("place", 1, digits).alias("head")).agg(
            F.sum("tokens").alias("t")
        )
        run = F.col("before") + F.sum("t").over(Window.partitionBy(*LEAF).orderBy("head"))
        found = heads.withColumn("end", run).where("end > rest and end - t <= rest")
        ended = stored(
            found.select(*LEAF, F.col("head").alias("below"), (F.col("end") - F.col("t")).alias("before")), "ended"
        )
    inside = _inside(keyed, ended).groupBy(*LEAF, "rest", "before", "place").agg(F.sum("tokens").alias("t"))
    run = F.sum("t").over(Window.partitionBy(*LEAF).orderBy("place"))
    last = inside.withColumn("end", F.col("before") + run).where("end <= rest").groupBy(*LEAF).agg(
        F.max("place").alias("upto")
    )
    return stored(leaves.join(ended.drop("before"), LEAF, "left").join(last, LEAF, "left"), "cuts")


def _inside(keyed: DataFrame, ended: DataFrame) -> DataFrame:
    """Rows of the one group of hashes in each leaf where the budget ends."""
    return keyed.join(ended, LEAF).where(F.expr("startswith(place, below)"))


def _copies(keyed: DataFrame, seed: int) -> DataFrame:
    """Adds how often each row is taken; rows have a leaf, doc_id, tokens and the leaf's cut."""
    inside = (F.col("place") < F.col("below")) | (F.col("place") <= F.coalesce("upto", F.lit("")))
    taken = F.when((F.col("rest") > 0) & F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    return keyed.withColumn("place", _place(seed)).withColumn(
        "copies", F.when(F.col("given") > 0, F.col("whole") + taken).otherwise(0).cast("long")
    )


def _leaf_columns(df: DataFrame, domain: Column) -> DataFrame:
    empty = F.lit("")
    return df.withColumn("domain", F.coalesce(domain, empty)).withColumns(
        {c: F.coalesce(F.col(c).cast("string"), empty) for c in ("lang", "source")}
    )


def mix(
    docs: DataFrame, domain: Column, budget: Column, weights: list[tuple[dict[str, int], int]], epochs: int = 1,
    seed: int = 1,
) -> DataFrame:
    """doc_id, leaf, tokens, given (the leaf's budget) and copies of every row.

    ``domain`` is an expression over doc_id, lang and source, ``budget`` one over all_tokens; ``weights`` are (names,
    default) of domains, languages and sources.
    """
    named = pick(docs, doc_id="doc_id", text="text", lang="lang", source="source")
    rows = stored(
        _leaf_columns(named, domain).select("doc_id", *LEAF, words().alias("tokens")), "tokens"
    )
    cut = cuts(rows, budget, weights, epochs, seed)
    return _copies(rows.join(cut, LEAF), seed).select("doc_id", *LEAF, "tokens", "given", "copies")


def mixed(
    docs: DataFrame, domain: Column, budget: Column, weights: list[tuple[dict[str, int], int]], epochs: int = 1,
    seed: int = 1,
) -> DataFrame:
    """The rows taken, with all their columns, each as often as it is taken."""
    named = pick(docs, doc_id="doc_id", text="text", lang="lang", source="source")
    rows = stored(_leaf_columns(named, domain).select("doc_id", *LEAF, words().alias("tokens")), "tokens")
    cut = cuts(rows, budget, weights, epochs, seed)
    whole = _leaf_columns(packed(docs, doc_id="doc_id", lang="lang", source="source"), domain)
    taken = _copies(whole.join(cut, LEAF), seed).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
