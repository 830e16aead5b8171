"""Alignment of runs on a phase boundary: long form first, wide form on request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brewlens.functions.scalars import MICROS_PER_HOUR, finite
from brewlens.operators.timeseries import of_variables
from brewlens.plans.ordered import PIECE, carry

SERIES = ["batch_id", "variable"]


def hours(us: Column) -> Column:
    return us / F.lit(float(MICROS_PER_HOUR))


def anchors(phases: DataFrame, anchor_phase: str = "exponential") -> DataFrame:
    """Start of the first phase of the given type per batch."""
    chosen = phases.where(F.col("phase_type") == anchor_phase)
    return chosen.groupBy("batch_id").agg(F.min("start_ts").alias("anchor_ts"))


def unanchored(telemetry: DataFrame, phases: DataFrame, anchor_phase: str = "exponential") -> DataFrame:
    """Batches that have telemetry but no phase of the anchor type."""
    return telemetry.select("batch_id").distinct().join(anchors(phases, anchor_phase), "batch_id", "left_anti")


def align(
    telemetry: DataFrame,
    phases: DataFrame,
    anchor_phase: str = "exponential",
    variables: Sequence[str] | None = None,
) -> DataFrame:
    """(batch_id, variable, elapsed_us, elapsed_hours, value): time from each batch's anchor.

    Hours are negative before the anchor. Runs are keyed by whole microseconds, so equal offsets meet.
    Readings of one variable at one time are averaged.
    """
    rows = of_variables(telemetry, variables).select(*SERIES, "ts", finite(F.col("value")).alias("value"))
    joined = rows.join(anchors(phases, anchor_phase), "batch_id")
    elapsed = F.unix_micros("ts") - F.unix_micros("anchor_ts")
    means = (
        joined.withColumn("elapsed_us", elapsed)
        .groupBy(*SERIES, "elapsed_us").agg(F.avg("value").alias("value"))
        .where("value is not null")
    )
    return means.select(*SERIES, "elapsed_us", hours(F.col("elapsed_us")).alias("elapsed_hours"), "value")


def resample(aligned: DataFrame, resolution_minutes: float, piece: int = PIECE) -> DataFrame:
    """Values on one uniform grid over all runs, linear in time between observations.

    Each observation emits the grid points up to the next one, so no window ever spans the grid. Points
    before a run's first observation stay absent; after its last one the value is held.
    """
    step = round(resolution_minutes * 60_000_000)
    if step < 1:
        raise ValueError("resolution_minutes is too small")
    span = aligned.agg(F.struct(F.min("elapsed_us").alias("low"), F.max("elapsed_us").alias("high"))).scalar()
    here = F.struct(F.col("elapsed_us").alias("t"), F.col("value").alias("v"))
    linked = carry(
        aligned.select(*SERIES, "elapsed_us", "value"), SERIES, ["elapsed_us"], F.col("elapsed_us"),
        backward={"next": (here, False)}, piece=piece,
    ).withColumn("span", span).withColumns({"low": F.col("span.low"), "high": F.col("span.high")})
    last_point = F.ceil((F.col("high") - F.col("low")) / step + 0.5) - 1
    k0 = F.ceil((F.col("elapsed_us") - F.col("low")) / step)
    k1 = F.when(F.col("next").isNull(), last_point).otherwise(
        F.least(F.ceil((F.col("next.t") - F.col("low")) / step) - 1, last_point)
    )
    points = linked.withColumns({"k0": k0, "k1": k1}).where("k0 <= k1").withColumn(
        "k", F.explode(F.sequence("k0", "k1"))
    )
    at = F.col("low") + F.col("k") * step
    share = (at - F.col("elapsed_us")) / (F.col("next.t") - F.col("elapsed_us"))
    value = F.when(F.col("next").isNull(), F.col("value")).otherwise(
        F.col("value") + (F.col("next.v") - F.col("value")) * share
    )
    return points.select(
        *SERIES, at.cast("long").alias("elapsed_us"), hours(at).alias("elapsed_hours"), value.alias("value")
    )


def series_names(aligned: DataFrame) -> DataFrame:
    """Distinct ``batch__variable`` names, the columns of the wide form."""
    return aligned.select(F.concat_ws("__", *SERIES).alias("series")).distinct()


def to_wide(aligned: DataFrame, series: Sequence[str]) -> DataFrame:
    """One row per time, one column per named series; absent values null."""
    named = aligned.withColumn("series", F.concat_ws("__", *SERIES))
    return (
        named.groupBy("elapsed_us", "elapsed_hours").pivot("series", list(series)).agg(F.min("value"))
        .drop("elapsed_us")
    )
