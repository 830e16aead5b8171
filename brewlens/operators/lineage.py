"""Process lineage: ancestors and descendants of unit operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from brewlens.session import drop_folder, shared_folder

#: Ways that one task joins or groups; a round has as many tasks as its ways need.
WAYS = 1 << 20


def edges(operations: DataFrame, across_batches: bool = False) -> DataFrame:
    """(batch_id, parent_id, child_id); parents that do not exist are ignored."""
    pairs = operations.select(
        "batch_id", F.explode("parent_ids").alias("parent_id"), F.col("operation_id").alias("child_id")
    ).distinct()
    known = operations.select("batch_id", F.col("operation_id").alias("parent_id"))
    if across_batches:
        return pairs.join(known.select("parent_id").distinct(), "parent_id", "left_semi")
    return pairs.join(known, ["batch_id", "parent_id"], "left_semi")


def closure(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, from_id, to_id, depth): all nodes reached from each node, with the length of the shortest way.

    Ways double: a round prolongs the ways of exactly 2**k steps by all of up to 2**k (every shortest way of up to twice
    as many begins with one), so that the number of rounds is the logarithm
    of the longest way and not its length. If no shortest way has exactly 2**k steps there is none longer. Each
    round is a table in the shared folder that replaces the one before; an observed maximum ends the loop without a job
    of its own. A way back to its start is none, which also ends cycles.
    """
    spark, folder = pairs.sparkSession, shared_folder(pairs.sparkSession, "lineage")
    columns = [*keys, "from_id", "to_id"]

    def write(rows: DataFrame) -> tuple[DataFrame, int, int]:
        longest = Observation()
        path = f"{folder}/{uuid.uuid4().hex}"
        rows.observe(longest, F.max("depth").alias("longest"), F.count(F.lit(1)).alias("n")).write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path), longest.get["longest"] or 0, longest.get["n"] or 0

    steps = 1
    ways, longest, n = write(pairs.where("from_id <> to_id").select(*columns, F.lit(1).alias("depth")).distinct())
    while longest == steps:
        # A number that is given is kept at run time; the round at most doubles the ways of trees and rings.
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * n // WAYS)
        onward = ways.select(
            *keys, F.col("from_id").alias("via"), F.col("to_id").alias("end_id"), F.col("depth").alias("more")
        )
        full = ways.where(F.col("depth") == steps).withColumnRenamed("to_id", "via")
        longer = full.repartition(parts, *keys, "via").join(onward.repartition(parts, *keys, "via"), [*keys, "via"]).where("from_id <> end_id")
        longer = longer.select(*keys, "from_id", F.col("end_id").alias("to_id"), (F.col("depth") + F.col("more")).alias("depth"))
        before = ways.inputFiles()
        both = ways.unionByName(longer).repartition(parts, *columns)
        ways, longest, n = write(both.groupBy(*columns).agg(F.min("depth").alias("depth")))
        if before:
            drop_folder(spark, before[0].rsplit("/", 1)[0])
        steps *= 2
    return ways


def _walk(operations: DataFrame, starts: DataFrame | None, down: bool, across_batches: bool) -> DataFrame:
    """From every start at once; with ``starts``, only their batches are looked at (all where ways cross batches)."""
    chosen = operations if starts is None else operations.join(starts.select("operation_id"), "operation_id", "left_semi")
    looked_at = operations
    if starts is not None and not across_batches:
        looked_at = operations.join(chosen.select("batch_id").distinct(), "batch_id", "left_semi")
    keys = [] if across_batches else ["batch_id"]
    step = edges(looked_at, across_batches).select(
        *keys, F.col("parent_id" if down else "child_id").alias("from_id"), F.col("child_id" if down else "parent_id").alias("to_id")
    )
    found = closure(step, keys).withColumnsRenamed({"from_id": "root_id", "to_id": "operation_id"})
    if across_batches:
        found = found.join(chosen.select("batch_id", F.col("operation_id").alias("root_id")), "root_id")
    elif starts is not None:
        found = found.join(chosen.select("batch_id", F.col("operation_id").alias("root_id")).distinct(), ["batch_id", "root_id"], "left_semi")
    return found.select("batch_id", "root_id", "operation_id", "depth")


def descendants(operations: DataFrame, starts: DataFrame | None = None, across_batches: bool = False) -> DataFrame:
    """(batch_id, root_id, operation_id, depth) below the given operations (all when ``starts`` is None)."""
    return _walk(operations, starts, True, across_batches)


def ancestors(operations: DataFrame, starts: DataFrame | None = None, across_batches: bool = False) -> DataFrame:
    """Like :func:`descendants`, towards the parents."""
    return _walk(operations, starts, False, across_batches)
