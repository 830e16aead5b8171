"""Signal preparation: validate, fill short gaps, smooth, down-sample, penalty.

All of it is window expressions: signals of every length are numbered, cut into fixed-size blocks with repeated edges,
and worked on block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brewlens import constants as K
from brewlens.functions.scalars import finite
from brewlens.plans.ordered import PIECE, halo_blocks, ordinals

KEYS = ["batch_id", "variable"]
BLOCK = 65_536


def _fill_expr(value: str, index: str, rows: Window, limit: int) -> Column:
    """Linear fill of interior runs of at most ``limit`` missing values, by position."""
    near = limit + 1
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    left = F.last(here, ignorenulls=True).over(rows.rowsBetween(-near, -1))
    right = F.first(here, ignorenulls=True).over(rows.rowsBetween(1, near))
    gap = right["i"] - left["i"] - 1
    filled = left["v"] + (right["v"] - left["v"]) * (F.col(index) - left["i"]) / (gap + 1)
    return F.coalesce(F.col(value), F.when(gap <= limit, filled))


def _smooth_expr(value: str, index: str, count: str, rows: Window, width: int) -> Column:
    """Centred mean of ``width`` rows with the end values repeated; null if the frame holds a null."""
    if width <= 1:
        return F.col(value)
    before = width // 2
    after = width - 1 - before
    frame = rows.rowsBetween(-before, after)
    i, n = F.col(index), F.col(count)
    missing_left = F.greatest(F.lit(0), F.lit(before) - i)
    missing_right = F.greatest(F.lit(0), i + F.lit(after) - (n - 1))
    present = F.lit(width) - missing_left - missing_right
    total = F.sum(value).over(frame)
    # The frame is cut at the ends of the signal, so its first/last row is the signal's first/last row.
    edge_left = F.when(missing_left > 0, missing_left * F.first(value).over(frame)).otherwise(F.lit(0.0))
    edge_right = F.when(missing_right > 0, missing_right * F.last(value).over(frame)).otherwise(F.lit(0.0))
    return F.when(F.count(value).over(frame) == present, (total + edge_left + edge_right) / F.lit(width))


def _windowed(df: DataFrame, rows: Window, width: int, limit: int) -> DataFrame:
    filled = df.withColumn("filled", _fill_expr("clean", "_i", rows, limit))
    return filled.withColumn("smoothed", _smooth_expr("filled", "_i", "_n", rows, width))


def prepare(
    telemetry: DataFrame, *, window: int = 5, limit: int = K.NAN_GAP_LIMIT, piece: int = PIECE, block: int = BLOCK
) -> DataFrame:
    """``clean``, ``filled``, ``smoothed``, ``_i`` and ``_n`` of every (batch, variable): validated, gap-filled, smoothed."""
    base = telemetry.select(*KEYS, "ts", "value").withColumn("clean", finite(F.col("value")))
    numbered = ordinals(base, KEYS, ["ts", "value"], F.unix_micros("ts"), piece)
    blocks = halo_blocks(numbered, "_i", block, window + limit + 1).where((F.col("_block") * block) < F.col("_n"))
    rows = Window.partitionBy(*KEYS, "_block").orderBy("_i")
    return _windowed(blocks, rows, window, limit).where("_own").drop("_block", "_own")


def invalid_signals(telemetry: DataFrame) -> DataFrame:
    """(batch, variable) pairs without a single finite value."""
    counts = telemetry.groupBy(*KEYS).agg(F.count(finite(F.col("value"))).alias("n_valid"))
    return counts.where("n_valid = 0").select(*KEYS)


def sample_number(max_samples: int) -> Column:
    """Which evenly spaced sample row ``_i`` of ``_n`` is (0-based), or null when it is none.

    Sample k sits at floor(k * (n-1)/(m-1)), the last at n-1. Each row decides for itself.
    """
    step = f"(cast(_n - 1 AS double) / {float(max_samples - 1)}D)"
    tests = "".join(
        f" WHEN floor((floor(_i / {step}) + {o}) * {step}) = _i AND floor(_i / {step}) + {o} < {max_samples - 1}"
        f" THEN floor(_i / {step}) + {o}" for o in (0, 1, 2)
    )
    return F.expr(f"CASE WHEN _n <= {max_samples} THEN _i WHEN _i = _n - 1 THEN {max_samples - 1}{tests} END").cast("long")


def downsample(df: DataFrame, max_samples: int = K.MAX_SAMPLES) -> DataFrame:
    """Keep at most ``max_samples`` evenly spaced rows per signal; adds ``_k``."""
    return df.withColumn("_k", sample_number(max_samples)).where("_k is not null")


def auto_penalty(df: DataFrame, value: str = "smoothed") -> DataFrame:
    """ln(n) * population variance per signal; near-constant signals use variance 1."""
    variance = F.var_pop(value)
    floor = F.when(variance < K.VARIANCE_FLOOR, 1.0).otherwise(variance)
    return df.groupBy(*KEYS).agg(
        F.count(value).alias("n"), (F.ln(F.count(value)) * floor).alias("penalty")
    )
