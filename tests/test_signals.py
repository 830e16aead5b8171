import numpy as np
import pytest
from pyspark.sql import functions as F

from brewlens.operators import signals
from tests.conftest import signal_rows

NAN = float("nan")


def prepared(telemetry, values, **options):
    rows = signals.prepare(telemetry(signal_rows("b", "x", values)), **options).orderBy("_i").collect()
    return [r["filled"] for r in rows], [r["smoothed"] for r in rows]


def test_only_short_interior_gaps_are_filled(telemetry):
    filled, _ = prepared(telemetry, [NAN, 1.0, NAN, NAN, 4.0, *[NAN] * 6, 5.0, NAN])
    assert filled[0] is None and filled[-1] is None
    assert filled[1:5] == [1.0, 2.0, 3.0, 4.0]
    assert filled[5:11] == [None] * 6
    filled, _ = prepared(telemetry, [0.0, *[NAN] * 5, 6.0, float("inf"), 8.0])
    assert filled == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]


@pytest.mark.parametrize("width", [1, 2, 4, 5, 7])
def test_smoothing_repeats_the_ends(telemetry, width):
    x = np.random.default_rng(1).normal(size=23)
    _, smoothed = prepared(telemetry, x, window=width)
    before = width // 2
    padded = np.pad(x, (before, width - 1 - before), mode="edge")
    expected = [padded[i:i + width].mean() for i in range(len(x))]
    assert np.allclose(smoothed, expected)


@pytest.mark.parametrize("n", [5, 10, 11, 37, 99, 1000])
def test_downsampling_takes_evenly_spaced_rows(telemetry, n):
    rows = signals.downsample(signals.prepare(telemetry(signal_rows("b", "x", range(n)))), 10)
    got = [(r["_k"], r["_i"]) for r in rows.orderBy("_k").collect()]
    expected = list(range(n)) if n <= 10 else np.linspace(0, n - 1, 10, dtype=int).tolist()
    assert got == list(enumerate(expected))


def test_penalty(telemetry):
    x = np.arange(1.0, 11.0)
    rows = telemetry(signal_rows("a", "x", x), signal_rows("c", "x", [2.0] * 8)).withColumn("v", F.col("value"))
    got = {r["batch_id"]: r["penalty"] for r in signals.auto_penalty(rows, "v").collect()}
    assert got["a"] == pytest.approx(np.log(10) * x.var())
    assert got["c"] == pytest.approx(np.log(8))


def test_signals_without_values_are_reported(telemetry):
    rows = telemetry(signal_rows("a", "x", [NAN, NAN]), signal_rows("b", "x", [1.0, NAN]))
    assert [r["batch_id"] for r in signals.invalid_signals(rows).collect()] == ["a"]
