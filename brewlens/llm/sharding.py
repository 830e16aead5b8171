"""Shards by proportional stratified interleaving, with DataFrame operations only.

Rows of a source are shuffled by a seeded hash of doc_id and ranked; rank r of n gets the fraction (2r - 1) / 2n. All
rows in the order of their fractions follow the mixture at every point, so cutting that order into equal runs of rows
gives shards of equal counts, each with the mixture of the whole table.

No source is ranked as one group. The hash falls into buckets of about ``RUN`` rows; a rank is the number of rows in a
source's earlier buckets plus the place within its bucket. As the ranks of a source are 1 to n, the number of rows
below a fraction follows from the sources' sizes alone, and with it the position of each run of fractions.

Defined cases: null source counts as the empty name, null doc_id as the empty text; null text has no bytes; rows with one
doc_id have one place in the shuffle and follow a hash of their columns (maps and variants left out), so equal rows are
interchangeable; the method forms no groups, copies of a text fall where their doc_id puts them; text length does not
matter; fewer rows than shards leave shards empty; an empty table gives no rows; other columns stay, whole, in ``row``.
Fractions are whole-number arithmetic: beyond 2**37 rows of a source it overflows with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brewlens.llm.common import packed, stored

#: Rows of a bucket of hashes and of a run of fractions, about; and the most runs, for the arithmetic's sake.
RUN, MOST_RUNS = 512, 1 << 25
#: Rows made from one row by ``explode`` at a time.
BLOCK = 4096
#: The law that holds between shards: their row counts are at most one apart.
LAW = "rows"


def _shuffled(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _content(df: DataFrame) -> Column:
    hashed = [f"row.`{f.name}`" for f in df.schema["row"].dataType if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*[F.expr(c) for c in hashed])


def _before(rows: DataFrame, order: str, count: str, *by: str) -> DataFrame:
    """``start``: the sum of ``count`` over smaller ``order`` within ``by``, in two steps of about the root of the rows."""
    half = F.shiftright(order, 12).alias("block")
    low = Window.partitionBy(*by, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    high = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("block", half)
    blocks = rows.groupBy(*by, "block").agg(F.sum(count).alias("held"))
    blocks = blocks.select(*by, "block", F.coalesce(F.sum("held").over(high), zero).alias("ahead"))
    return rows.withColumn("within", F.coalesce(F.sum(count).over(low), zero)).join(blocks, [*by, "block"]).withColumn(
        "start", F.col("ahead") + F.col("within")
    ).drop("block", "ahead", "within", count)


def _runs(sizes: DataFrame, runs: int) -> DataFrame:
    """(run, start): rows of all sources below each run of fractions, from the sources' sizes (source, n) alone."""
    last = F.least(F.col("n"), F.lit(runs)) - 1
    items = sizes.select("n", last.alias("last")).select("n", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {BLOCK}"))).alias("b"))
    items = items.select("n", F.explode(F.sequence(F.col("b") * BLOCK, F.least(F.col("last"), F.col("b") * BLOCK + BLOCK - 1))).alias("i"))
    upto = "((2 * n * {} + {runs} - 1) div {runs}) div 2"
    counted = items.select(
        F.when(F.col("n") < runs, F.expr(f"((2 * i + 1) * {runs}) div (2 * n)")).otherwise(F.col("i")).alias("run"),
        F.when(F.col("n") < runs, F.lit(1)).otherwise(
            F.expr(upto.format("(i + 1)", runs=runs)) - F.expr(upto.format("i", runs=runs))
        ).cast("long").alias("held"),
    )
    return _before(counted.groupBy("run").agg(F.sum("held").alias("held")), "run", "held")


def sharded(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """``row`` (all columns of ``docs``), ``shard`` and ``slot`` (its place in the shard, from 0) of every row."""
    rows = packed(docs, doc_id="doc_id", source="source")
    rows = rows.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), _shuffled(seed).alias("key"),
        _content(rows).alias("content"), "row",
    )
    total = docs.count()
    bits = min(32, (total // RUN).bit_length())
    runs = min(MOST_RUNS, max(1, total // RUN))
    bucket = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits)
    counts = stored(rows.select("source", bucket.alias("bucket")).groupBy("source", "bucket").agg(F.count("*").alias("held")), "buckets")
    sizes = stored(counts.groupBy("source").agg(F.sum("held").alias("n")), "sizes")
    starts = stored(_before(counts, "bucket", "held", "source").join(sizes, "source"), "starts")
    ahead = stored(_runs(sizes, runs), "runs")

    place = Window.partitionBy("source", "bucket").orderBy("key", "content")
    ranked = rows.withColumn("bucket", bucket).join(starts, ["source", "bucket"]).select(
        "source", "n", "row", (F.col("start") + F.row_number().over(place)).alias("rank")
    )
    ranked = ranked.select(
        "row", "source", F.expr(f"((2 * rank - 1) * {runs}) div (2 * n)").alias("run"),
        ((2 * F.col("rank") - 1).cast("double") / (2 * F.col("n")).cast("double")).alias("fraction"),
    )
    order = Window.partitionBy("run").orderBy("fraction", "source")
    placed = ranked.join(ahead, "run").select("row", (F.col("start") + F.row_number().over(order) - 1).alias("at"))
    shard = F.expr(f"(at * {shards}) div {max(total, 1)}")
    return placed.select("row", shard.cast("int").alias("shard"), "at").select(
        "row", "shard", (F.col("at") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).alias("slot")
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder a shard; its files follow one another in the order of their slots."""
    ordered = placed.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("shard") == shard)
