"""Telemetry and assay operators: selection, as-of joins, unions, summaries, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brewlens.functions.scalars import finite
from brewlens.plans.ordered import PIECE, carry


def of_batch(df: DataFrame, batch_id: str) -> DataFrame:
    return df.where(F.col("batch_id") == F.lit(batch_id))


def of_variables(df: DataFrame, variables: Sequence[str] | None) -> DataFrame:
    return df if variables is None else df.where(F.col("variable").isin(list(variables)))


def time_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with ``start <= ts < end``; both bounds reach the Parquet scan."""
    return df.where(
        (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp"))
    )


def union_assay(telemetry: DataFrame, assay: DataFrame) -> DataFrame:
    """Telemetry and assay rows under one schema, missing columns null."""
    return telemetry.unionByName(assay, allowMissingColumns=True)


# --- as-of joins -----------------------------------------------------------------------------------------


def _asof(telemetry: DataFrame, assay: DataFrame, keys: list[str], piece: int) -> DataFrame:
    """Last telemetry row at or before each assay row, per key.

    Both sides are tagged and merged, so the match is a running ``last`` instead of a non-equi join:
    one shuffle of the merged rows, linear in their number whatever the timestamps look like.
    """
    sensor = F.struct(
        F.col("ts").alias("telemetry_ts"), F.col("variable").alias("sensor"),
        F.col("value").alias("sensor_value"), F.col("unit").alias("sensor_unit"),
    )
    left = telemetry.select(
        *keys, "ts", F.lit(0).alias("side"), F.col("variable").alias("tie"), F.col("value").alias("tie_value"),
        sensor.alias("hit"), F.lit(None).cast("struct<analyte:string,assay_value:double,"
                                               "assay_uncertainty:double,assay_unit:string,"
                                               "assay_method:string>").alias("probe"),
    )
    right = assay.select(
        *keys, "ts", F.lit(1).alias("side"),
        (F.col("analyte") if "analyte" in assay.columns else F.col("variable")).alias("tie"),
        F.col("value").alias("tie_value"),
        F.lit(None).cast("struct<telemetry_ts:timestamp,sensor:string,sensor_value:double,"
                         "sensor_unit:string>").alias("hit"),
        F.struct(
            (F.col("analyte") if "analyte" in assay.columns else F.col("variable")).alias("analyte"),
            F.col("value").alias("assay_value"), F.col("uncertainty").alias("assay_uncertainty"),
            F.col("unit").alias("assay_unit"), F.col("method").alias("assay_method"),
        ).alias("probe"),
    )
    merged = left.unionByName(right)
    matched = carry(
        merged, keys, ["ts", "side", "tie", "tie_value"], F.unix_micros("ts"),
        forward={"match": (F.col("hit"), False)}, piece=piece,
    )
    return matched.where((F.col("side") == 1) & F.col("match").isNotNull())


def unified_view(telemetry: DataFrame, assay: DataFrame, piece: int = PIECE) -> DataFrame:
    """Each assay row with the newest telemetry row of its batch at or before it.

    Assay rows without earlier telemetry are dropped; among sensors that share the timestamp the last one
    by name is taken, so the result does not depend on row order.
    """
    hits = _asof(telemetry, assay, ["batch_id"], piece)
    return hits.select(
        "batch_id", F.col("ts").alias("assay_ts"), "probe.analyte", "probe.assay_value",
        "probe.assay_uncertainty", "probe.assay_unit", "probe.assay_method",
        "match.telemetry_ts", "match.sensor", "match.sensor_value", "match.sensor_unit",
    )


def unified_view_per_sensor(
    telemetry: DataFrame, assay: DataFrame, piece: int = PIECE
) -> DataFrame:
    """Like :func:`unified_view`, with one match per sensor of the batch."""
    sensors = telemetry.select("batch_id", "variable").distinct()
    probes = assay.withColumnRenamed("variable", "analyte").join(sensors, "batch_id")
    hits = _asof(telemetry, probes, ["batch_id", "variable"], piece)
    return hits.select(
        "batch_id", F.col("ts").alias("assay_ts"), "probe.analyte", "probe.assay_value",
        "probe.assay_uncertainty", "probe.assay_unit", "probe.assay_method",
        "match.telemetry_ts", "match.sensor", "match.sensor_value", "match.sensor_unit",
    )


# --- aggregation and pivots --------------------------------------------------------------------------------


def mean_of_duplicates(df: DataFrame, time: Sequence[str] = ("ts",)) -> DataFrame:
    """Mean value per (batch, variable, time); NaN counts as missing."""
    return df.groupBy("batch_id", "variable", *time).agg(F.avg(finite(F.col("value"))).alias("value"))


def pivot_first(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Wide form per (batch, ts): the smallest of duplicate readings of each variable."""
    return df.groupBy("batch_id", "ts").pivot("variable", list(variables)).agg(F.min("value"))


def batch_summary(df: DataFrame, biomass: str, oxygen: str) -> DataFrame:
    """One row per batch: points, time range, distinct variables, peak biomass, lowest oxygen."""
    value = finite(F.col("value"))
    return df.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_distinct("variable").alias("n_variables"),
        F.max(F.when(F.col("variable") == biomass, value)).alias("max_biomass"),
        F.min(F.when(F.col("variable") == oxygen, value)).alias("min_oxygen"),
    )


def compare_batches(df: DataFrame) -> DataFrame:
    """Per variable and batch: count, mean, extremes — the side-by-side comparison."""
    value = finite(F.col("value"))
    return df.groupBy("variable", "batch_id").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )


def zscores(df: DataFrame) -> DataFrame:
    """Population z-score per (batch, variable); constant signals give 0.

    The statistics are combined before their shuffle and joined back, so a hot signal is never gathered in one
    window; adaptive execution splits it in the join.
    """
    value = finite(F.col("value"))
    stats = df.groupBy("batch_id", "variable").agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std")
    )
    scored = df.join(stats, ["batch_id", "variable"])
    z = F.when(F.col("_std") > 1e-10, (value - F.col("_mean")) / F.col("_std")).otherwise(F.lit(0.0))
    return scored.select(*df.columns, z.alias("z"))


def first_last(df: DataFrame, order: Column) -> DataFrame:
    """First and last (value, uncertainty) per (batch, variable) as structs."""
    reading = F.struct("value", "uncertainty")
    rank = F.struct(order, "value", "uncertainty")
    return df.groupBy("batch_id", "variable").agg(
        F.min_by(reading, rank).alias("first"), F.max_by(reading, rank).alias("last"),
        F.count(F.lit(1)).alias("n"),
    )


def missing_variables(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """(batch_id, variable) pairs that are required but absent."""
    batches = df.select("batch_id").distinct()
    wanted = batches.withColumn("variable", F.explode(F.array(*[F.lit(v) for v in required])))
    present = df.select("batch_id", "variable").distinct()
    return wanted.join(present, ["batch_id", "variable"], "left_anti")
