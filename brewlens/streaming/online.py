"""Structured Streaming: online changepoints per signal, and continuous telemetry ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brewlens.functions import scalars as S
from brewlens.operators.phases import OnlineConfig
from brewlens.schemas import TELEMETRY
from brewlens.sources.landed import SourceMapping, wide_to_telemetry

OUTPUT = (
    "batch_id string, variable string, ts timestamp, value double, detected boolean, short_mass double, "
    "late boolean, late_dropped long"
)
STATE = "t long, last_us long, late long, probs array<double>, mu array<double>, beta array<double>"


def detect_online(stream: DataFrame, config: OnlineConfig = OnlineConfig(), all_signals: bool = False) -> DataFrame:
    """One output row per observation with the detector's verdict.

    State per (batch, variable) is the run-length posterior, at most ``max_run_length + 1`` entries in
    each of three arrays. Inside a micro-batch values are taken in time order. Values older than the last one
    already taken come out with ``late`` set and without a verdict; ``late_dropped`` counts them.
    """
    signals = stream if all_signals else stream.where(F.col("variable") == config.signal)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        posterior = config.posterior()
        last, late = -(2**62), 0
        if state.exists:
            t, last, late, probs, mu, beta = state.get
            posterior.restore(t, probs, mu, beta)
        rows = pd.concat(list(parts)).sort_values(["ts", "value"])
        us = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        fresh = us >= last
        late += int((~fresh).sum())
        verdicts = [posterior.update(float(v)) if new else (None, None) for v, new in zip(rows["value"], fresh, strict=True)]
        if len(us):
            last = max(last, int(us[-1]))
        t, probs, mu, beta = posterior.state()
        state.update((t, last, late, probs, mu, beta))
        yield pd.DataFrame({
            "batch_id": key[0], "variable": key[1], "ts": rows["ts"].to_numpy(), "value": rows["value"].to_numpy(),
            "detected": pd.array([d for d, _ in verdicts], dtype="boolean"), "short_mass": [m for _, m in verdicts],
            "late": ~fresh, "late_dropped": late,
        })

    return signals.select("batch_id", "variable", "ts", "value").groupBy("batch_id", "variable").applyInPandasWithState(
        step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )


def telemetry_stream(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Stored or landing telemetry files as a stream."""
    return spark.readStream.schema(TELEMETRY).option("maxFilesPerTrigger", max_files).parquet(path)


def ingest_stream(landing: DataFrame, mapping: SourceMapping, batch_id: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append mapped and unit-normalised telemetry of a landing stream to Parquet, exactly once."""
    rows = wide_to_telemetry(landing, mapping, F.col(batch_id), normalise=True).withColumn(
        "quality_flag", S.quality_flag(F.col("variable"), F.col("value"))
    )
    return (
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
