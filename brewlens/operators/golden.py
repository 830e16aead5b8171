"""Golden-batch profiles and dynamic-time-warping scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brewlens.functions import kernels
from brewlens.functions.scalars import finite
from brewlens.plans.skew import spread

SCORE = "struct<score:double,dtw_normalized_distance:double,error:string>"


def golden_profile(
    aligned: DataFrame, batch_ids: Sequence[str], variables: Sequence[str], profile_id: str = "golden"
) -> DataFrame:
    """Mean and population deviation per time and variable over the named runs.

    Runs without a value at a time do not count there.
    """
    if not batch_ids or not variables:
        raise ValueError("batch_ids and variables must be given")
    chosen = aligned.where(F.col("batch_id").isin(list(batch_ids)) & F.col("variable").isin(list(variables)))
    return profile_of(chosen, profile_id)


def profile_of(aligned: DataFrame, profile_id: str = "golden") -> DataFrame:
    """Profile over all rows of ``aligned`` (for runs selected by a join rather than by name)."""
    value = finite(F.col("value"))
    return aligned.groupBy("elapsed_us", "elapsed_hours", "variable").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n_batches"),
    ).where("mean is not null").select(
        F.lit(profile_id).alias("profile_id"), "elapsed_us", "elapsed_hours", "variable", "mean", "std", "n_batches"
    )


def missing_series(aligned: DataFrame, batch_ids: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Named (batch, variable) pairs without a single aligned value."""
    spark = aligned.sparkSession
    wanted = spark.createDataFrame([(b, v) for b in batch_ids for v in variables], "batch_id string, variable string")
    return wanted.join(aligned.select("batch_id", "variable").distinct(), ["batch_id", "variable"], "left_anti")


def envelope(profile: DataFrame) -> DataFrame:
    return profile.withColumns({"lower": F.col("mean") - F.col("std"), "upper": F.col("mean") + F.col("std")})


def profile_matrix(profile: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row per profile: hours and the (time x variable) mean and std matrices.

    Gathers one profile, whose length is the number of grid times, into one row.
    """
    def column(name: str):
        return F.array(*[F.max(F.when(F.col("variable") == v, F.col(name))) for v in variables])

    per_time = profile.groupBy("profile_id", "elapsed_us", "elapsed_hours").agg(
        column("mean").alias("m"), column("std").alias("s")
    )
    rows = F.sort_array(F.collect_list(F.struct("elapsed_us", "elapsed_hours", "m", "s")))
    return per_time.groupBy("profile_id").agg(rows.alias("rows")).select(
        "profile_id",
        F.transform("rows", lambda r: r["elapsed_hours"]).alias("elapsed_hours"),
        F.transform("rows", lambda r: r["m"]).alias("mean_trajectory"),
        F.transform("rows", lambda r: r["s"]).alias("std_trajectory"),
    )


def trajectories(df: DataFrame, variables: Sequence[str], time: str = "ts") -> DataFrame:
    """One row per batch: the (time x variable) matrix of mean readings ordered by time.

    Warping needs both whole sequences, so a batch becomes one row; duplicates are averaged first. Runs
    sampled faster than the comparison needs should be passed through ``resample`` before.
    """
    value = finite(F.col("value"))
    per_time = df.where(F.col("variable").isin(list(variables))).groupBy("batch_id", time).agg(
        F.array(*[F.avg(F.when(F.col("variable") == v, value)) for v in variables]).alias("v")
    )
    points = F.sort_array(F.collect_list(F.struct(time, "v")))
    return spread(per_time, "batch_id").groupBy("batch_id").agg(points.alias("points")).select(
        "batch_id", F.transform("points", lambda p: p["v"]).alias("trajectory")
    )


def score_batches(
    df: DataFrame,
    profile: DataFrame,
    variables: Sequence[str],
    time: str = "ts",
    max_distance: float = 2.0,
    profile_id: str = "golden",
) -> DataFrame:
    """Score 0..100 of every batch against the named profile; batches that cannot be scored say why."""
    chosen = profile.where(F.col("profile_id") == profile_id)
    mean = profile_matrix(chosen, variables).select("profile_id", "mean_trajectory")
    runs = trajectories(df, variables, time).withColumn("profile_id", F.lit(profile_id))
    paired = runs.join(mean, "profile_id")

    @F.pandas_udf(SCORE)
    def score(runs: pd.Series, means: pd.Series) -> pd.DataFrame:
        out = []
        for run, ref in zip(runs, means, strict=True):
            a, b = np.stack(run).astype(float), np.stack(ref).astype(float)
            if np.isnan(a).any():
                out.append((None, None, "variables are not sampled at the same times"))
            elif np.isnan(b).any():
                out.append((None, None, "profile lacks values of a variable"))
            else:
                out.append((*kernels.golden_score(a, b, max_distance), None))
        return pd.DataFrame(out, columns=["score", "dtw_normalized_distance", "error"])

    return paired.withColumn("r", score("trajectory", "mean_trajectory")).select(
        "batch_id", "profile_id", "r.score", "r.dtw_normalized_distance",
        F.size("trajectory").alias("n_points"), "r.error",
    )
