from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from brewlens.operators import alignment, golden, metrics, sensors
from brewlens.operators import timeseries as ts
from brewlens.plans.ordered import PIECE
from tests.conftest import START, signal_rows

PHASES = "batch_id string, phase_type string, start_ts timestamp, end_ts timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


# --- metrics


def test_growth_rate_and_fit(telemetry):
    t = np.arange(24) / 6
    rows = telemetry(signal_rows("a", "X", 0.2 * np.exp(0.3 * t), 600), signal_rows("flat", "X", [2.0] * 5, 600),
                     signal_rows("neg", "X", [1.0, -1.0], 600), signal_rows("one", "X", [1.0], 600))
    hours = (F.unix_micros("ts") - F.lit(int(START.timestamp() * 1e6))) / 3.6e9
    got = {r["batch_id"]: r for r in metrics.growth_rates(rows, ["batch_id"], hours, F.col("value")).collect()}
    assert got["a"]["mu"] == pytest.approx(0.3) and got["a"]["r_squared"] == pytest.approx(1.0)
    assert got["a"]["std_error"] == pytest.approx(0.0, abs=1e-7)
    assert got["flat"]["mu"] == pytest.approx(0.0) and got["flat"]["r_squared"] == 0.0
    assert got["neg"]["mu"] is None and got["one"]["mu"] is None


def test_batch_metrics_by_phase(spark, telemetry):
    n = 13
    h = np.arange(n) / 6
    rows = telemetry(
        signal_rows("a", "OD600", np.exp(0.3 * h), 600), signal_rows("a", "prod", np.linspace(0, 1, n), 600),
        signal_rows("a", "glc", np.linspace(20, 10, n), 600), signal_rows("a", "glc", [9.0, 8.0], 600, at(130)),
    )
    bands = spark.createDataFrame([("a", "exponential", at(0), at(120)), ("a", "stationary", at(130), at(200))], PHASES)
    got = metrics.batch_metrics(rows, bands, "OD600", "prod", "glc").collect()
    assert len(got) == 1  # the second phase has no biomass
    m = got[0]
    assert m["mu"] == pytest.approx(0.3) and m["r_squared"] > 0.95
    assert m["qp"] == pytest.approx(0.5)
    assert m["yx_s"] == pytest.approx((np.exp(0.6) - 1) / 10) and m["yp_s"] == pytest.approx(0.1)
    plain = metrics.batch_metrics(rows, bands).collect()
    assert plain[0]["qp"] is None and plain[0]["mu"] == pytest.approx(0.3)


def test_yields_use_the_common_time_range(spark, telemetry):
    rows = telemetry(signal_rows("a", "OD600", [1.0, 2.0, 3.0, 4.0], 600),
                     signal_rows("a", "glc", [10.0, 8.0, 6.0], 600, at(10)))
    bands = spark.createDataFrame([("a", "lag", at(0), at(60))], PHASES)
    assert metrics.batch_metrics(rows, bands, substrate="glc").first()["yx_s"] == pytest.approx((4 - 2) / 4)
    # fewer than two common points: all points of both are used
    late = telemetry(signal_rows("a", "OD600", [1.0, 2.0], 600), signal_rows("a", "glc", [10.0, 8.0], 600, at(30)))
    assert metrics.batch_metrics(late, bands, substrate="glc").first()["yx_s"] == pytest.approx(0.5)
    flat = telemetry(signal_rows("a", "OD600", [1.0, 2.0], 600), signal_rows("a", "glc", [5.0, 5.0], 600))
    assert metrics.batch_metrics(flat, bands, substrate="glc").first()["yx_s"] == 0.0


def test_yield_with_uncertainty(spark):
    rows = spark.createDataFrame(
        [("a", at(0), "x", 0.5, 0.1), ("a", at(60), "x", 5.0, 0.2), ("a", at(0), "s", 20.0, 0.5), ("a", at(60), "s", 10.0, 0.5),
         ("b", at(0), "x", 1.0, 0.1), ("b", at(60), "x", 2.0, 0.1), ("b", at(0), "s", 5.0, 0.1), ("b", at(60), "s", 5.0, 0.1)],
        "batch_id string, ts timestamp, variable string, value double, uncertainty double")
    got = {r["batch_id"]: r for r in metrics.yields_with_uncertainty(rows, "s", "x").collect()}
    sigma = np.sqrt((0.1**2 + 0.2**2) / 100 + 4.5**2 * (0.5**2 + 0.5**2) / 1e4)
    assert got["a"]["yield"] == pytest.approx(0.45) and got["a"]["sigma"] == pytest.approx(sigma)
    assert (got["b"]["yield"], got["b"]["sigma"]) == (0.0, 0.0)


def test_productivity(telemetry):
    rows = telemetry(signal_rows("a", "P", [0.0, 1.0], 7200), signal_rows("b", "P", [1.0, 3.0], 0),
                     signal_rows("c", "P", [1.0]))
    got = {r["batch_id"]: r["qp"] for r in metrics.productivity(rows, ["batch_id"]).collect()}
    assert got == {"a": 0.5, "b": 0.0, "c": None}


# --- alignment


@pytest.fixture
def runs(spark, telemetry):
    rows = telemetry(signal_rows("r1", "OD", range(5), 1800), signal_rows("r2", "OD", range(10, 14), 3600),
                     signal_rows("r1", "pH", [7.0, 7.2], 1800))
    bands = spark.createDataFrame(
        [("r1", "lag", at(0), at(60)), ("r1", "exponential", at(60), at(90)), ("r1", "exponential", at(90), at(120)),
         ("r2", "exponential", at(60), at(200))], PHASES)
    return rows, bands


def test_alignment_counts_from_the_first_anchor(runs):
    rows, bands = runs
    got = alignment.align(rows, bands).where("variable = 'OD'").orderBy("batch_id", "elapsed_us").collect()
    assert [(r["batch_id"], r["elapsed_hours"], r["value"]) for r in got] == [
        ("r1", -1.0, 0.0), ("r1", -0.5, 1.0), ("r1", 0.0, 2.0), ("r1", 0.5, 3.0), ("r1", 1.0, 4.0),
        ("r2", -1.0, 10.0), ("r2", 0.0, 11.0), ("r2", 1.0, 12.0), ("r2", 2.0, 13.0)]
    assert alignment.unanchored(rows, bands.where("batch_id = 'r1'")).first()["batch_id"] == "r2"


def test_wide_form_is_an_outer_union_of_times(runs):
    aligned = alignment.align(*runs)
    names = sorted(r["series"] for r in alignment.series_names(aligned).collect())
    assert names == ["r1__OD", "r1__pH", "r2__OD"]
    wide = alignment.to_wide(aligned, names).orderBy("elapsed_hours")
    assert wide.columns == ["elapsed_hours", *names]
    assert [tuple(r) for r in wide.collect()] == [
        (-1.0, 0.0, 7.0, 10.0), (-0.5, 1.0, 7.2, None), (0.0, 2.0, None, 11.0), (0.5, 3.0, None, None),
        (1.0, 4.0, None, 12.0), (2.0, None, None, 13.0)]


def test_resampling_equals_interpolation(spark, telemetry):
    r = np.random.default_rng(0)
    parts, bands = [], []
    for b in range(3):
        offsets = np.sort(r.choice(np.arange(0, 400), 20 + 40 * b, replace=False))
        parts.append([(f"r{b}", at(int(m)), "OD", float(r.normal()), None) for m in offsets])
        bands.append((f"r{b}", "exponential", at(50 + b), at(500)))
    rows = telemetry(*parts)
    aligned = alignment.align(rows, spark.createDataFrame(bands, PHASES))
    cut = 900_000_000
    for piece in (PIECE, cut):
        got = alignment.resample(aligned, 7, piece).collect()
        series = aligned.toPandas()
        low, high = series.elapsed_us.min(), series.elapsed_us.max()
        step = 7 * 60_000_000
        grid = np.arange(low, high + step / 2, step)
        for b, mine in series.groupby("batch_id"):
            mine = mine.sort_values("elapsed_us")
            expected = {int(g): v for g, v in zip(grid, np.interp(grid, mine.elapsed_us, mine.value))
                        if g >= mine.elapsed_us.min()}
            found = {x["elapsed_us"]: x["value"] for x in got if x["batch_id"] == b}
            assert found.keys() == expected.keys()
            assert all(found[g] == pytest.approx(expected[g]) for g in found)
    with pytest.raises(ValueError):
        alignment.resample(aligned, 0)


# --- golden batches


@pytest.fixture
def aligned_runs(spark):
    hours = np.linspace(0, 24, 50)
    rows = []
    for i in range(4):
        for h in hours:
            us = int(round(h * 3.6e9))
            noise = 0.01 * np.sin(i + h)
            rows.append((f"B{i}", "OD600", us, us / 3.6e9, float(np.exp(h / 10) + noise)))
            rows.append((f"B{i}", "pH", us, us / 3.6e9, float(7 - h / 50 + noise)))
            if i == 3:
                rows[-2] = (f"B{i}", "OD600", us, us / 3.6e9, float(np.exp((24 - h) / 10)))
                rows[-1] = (f"B{i}", "pH", us, us / 3.6e9, float(6 + h / 50))
    return spark.createDataFrame(
        rows, "batch_id string, variable string, elapsed_us long, elapsed_hours double, value double")


def test_profile_and_scores(aligned_runs):
    variables = ["OD600", "pH"]
    profile = golden.golden_profile(aligned_runs, ["B0", "B1", "B2"], variables)
    assert profile.count() == 100 and profile.agg(F.max("n_batches")).first()[0] == 3
    matrix = golden.profile_matrix(profile, variables).first()
    data = aligned_runs.toPandas()
    for v, name in enumerate(variables):
        pivot = data[(data.variable == name) & (data.batch_id != "B3")].pivot(
            index="elapsed_us", columns="batch_id", values="value")
        assert np.allclose([m[v] for m in matrix["mean_trajectory"]], pivot.mean(axis=1))
        assert np.allclose([s[v] for s in matrix["std_trajectory"]], pivot.std(axis=1, ddof=0))
    assert matrix["elapsed_hours"] == sorted(matrix["elapsed_hours"])
    scores = {r["batch_id"]: r for r in golden.score_batches(
        aligned_runs, profile, variables, time="elapsed_us").collect()}
    assert all(scores[b]["score"] >= 90 for b in ("B0", "B1", "B2")) and scores["B3"]["score"] < 60
    band = golden.envelope(profile).first()
    assert band["upper"] - band["lower"] == pytest.approx(2 * band["std"])


def test_unscorable_batches_say_why(aligned_runs):
    variables = ["OD600", "pH"]
    profile = golden.profile_of(aligned_runs)
    partial = aligned_runs.where("not (batch_id = 'B1' and variable = 'pH' and elapsed_hours > 12)")
    scores = {r["batch_id"]: r for r in golden.score_batches(
        partial, profile, variables, time="elapsed_us").collect()}
    assert scores["B1"]["score"] is None and "same times" in scores["B1"]["error"]
    assert scores["B0"]["error"] is None
    gaps = golden.missing_series(aligned_runs, ["B0", "B9"], ["OD600", "x"]).collect()
    assert {(r["batch_id"], r["variable"]) for r in gaps} == {("B0", "x"), ("B9", "x"), ("B9", "OD600")}
    with pytest.raises(ValueError):
        golden.golden_profile(aligned_runs, [], variables)


# --- soft sensors


def models():
    """Model classes made inside a function travel to the workers by value."""

    class Ratio(sensors.Sensor):
        output_variable = "ratio"
        input_variables = ("a", "b")

        def predict(self, inputs, timestamps):
            return inputs["a"] / inputs["b"], None

    class Running(sensors.Sensor):
        output_variable = "sum"
        input_variables = ("a",)
        sequential = True

        def predict(self, inputs, timestamps):
            return np.cumsum(inputs["a"]), np.full(len(timestamps), 0.5)

    class Broken(Running):
        def predict(self, inputs, timestamps):
            return inputs["a"][:-1], None

    return Ratio(), Running(), Broken()


def test_sensors(telemetry):
    ratio_model, running_model, broken_model = models()
    rows = telemetry(signal_rows("x", "a", [1, 2, 3, 4, 5], 60), signal_rows("x", "b", [2, 2, 2, 2], 60))
    linear = sensors.apply_sensor(sensors.LinearSensor("a", "y", 2.0, 0.5, 0.5), rows).orderBy("ts").collect()
    assert [r["value"] for r in linear] == [2.5, 4.5, 6.5, 8.5, 10.5]
    assert {(r["uncertainty"], r["source"], r["variable"]) for r in linear} == {(0.5, "soft_sensor", "y")}
    ratio = sensors.apply_sensor(ratio_model, rows).orderBy("ts").collect()
    assert [r["value"] for r in ratio][:4] == [0.5, 1.0, 1.5, 2.0] and len(ratio) == 5
    running = sensors.apply_sensor(running_model, rows).orderBy("ts").collect()
    assert [r["value"] for r in running] == [1, 3, 6, 10, 15] and running[0]["uncertainty"] == 0.5
    with pytest.raises(Exception, match="4 values for 5 timestamps"):
        sensors.apply_sensor(broken_model, rows).collect()
    both = sensors.with_predictions(rows, sensors.apply_sensor(running_model, rows))
    assert both.count() == 14 and both.where("source is null").count() == 9
    assert [r["variable"] for r in ts.missing_variables(rows, ["a", "z"]).collect()] == ["z"]


def test_zscores_and_summary(telemetry):
    x = np.arange(6.0)
    rows = telemetry(signal_rows("a", "od", x), signal_rows("a", "do", [3.0] * 4))
    z = [r["z"] for r in ts.zscores(rows).where("variable = 'od'").orderBy("ts").collect()]
    assert np.allclose(z, (x - x.mean()) / x.std())
    assert {r["z"] for r in ts.zscores(rows).where("variable = 'do'").collect()} == {0.0}
    s = ts.batch_summary(rows, "od", "do").first()
    assert (s["n_points"], s["n_variables"], s["max_biomass"], s["min_oxygen"]) == (10, 2, 5.0, 3.0)


def test_rounds_of_lineage_have_as_many_tasks_as_their_ways_need(spark, monkeypatch):
    """A ring and a tree against a walk step by step; ways are spread by their number."""
    from brewlens.operators import lineage

    monkeypatch.setattr(lineage, "WAYS", 20)
    steps = [(f"r{i}", f"r{(i + 1) % 13}") for i in range(13)] + [(f"t{(i - 1) // 2}", f"t{i}") for i in range(1, 31)]
    found = lineage.closure(spark.createDataFrame(steps, "from_id string, to_id string"), [])
    after: dict[str, list[str]] = {}
    for a, b in steps:
        after.setdefault(a, []).append(b)
    want = set()
    for start in after:
        seen, at, depth = {start}, [start], 0
        while at:
            depth += 1
            at = [b for b in {b for a in at for b in after.get(a, [])} if b not in seen]
            seen.update(at)
            want |= {(start, b, depth) for b in at}
    assert {tuple(r) for r in found.select("from_id", "to_id", "depth").collect()} == want
    assert len(found.inputFiles()) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_weighted_sensors_group_nothing_after_the_join(spark, telemetry):
    from brewlens.operators import sensors
    from brewlens.schemas import SENSORS

    def record(name, kind, inputs, weights, **more):
        row = {"sensor_id": name, "output_variable": f"est_{name}", "input_variables": inputs, "model_type": kind,
               "coefficients": weights, "intercept": 1.0, "prediction_std": 0.5} | more
        return tuple(row.get(f) for f in SENSORS.names)

    records = spark.createDataFrame([
        record("one", "linear", ["a"], [2.0]), record("both", "pls", ["b", "a"], [3.0, 1.0], center=[1.0, 0.0], scale=[2.0, 1.0]),
        record("twice", "linear", ["a", "a"], [1.0, 1.0]), record("never", "linear", ["a", "z"], [1.0, 1.0]),
    ], SENSORS)
    rows = telemetry(signal_rows("x", "a", [1, 2, float("nan")]), signal_rows("x", "b", [5, 5]), signal_rows("x", "a", [0.5]))
    made = sensors.apply_records(records, rows)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Aggregate" not in plan[: plan.index("BroadcastHashJoin")]
    assert sorted((r["sensor_id"], r["value"]) for r in made.collect()) == [
        ("both", 7.5), ("both", 9.0), ("one", 2.0), ("one", 5.0), ("twice", 2.0), ("twice", 5.0)]


def test_detected_phases_are_found_once(spark, tmp_path):
    from brewlens.workload import queries

    spark.range(120).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"),
        (F.col("id") % 2).alias("user_id"), F.lit("click").alias("event_type"), F.exp(F.col("id") / 40).alias("value"),
        F.lit("").alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    found = queries()["detected_metrics"](spark, str(tmp_path))
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("phase_type = 'exponential'").count() == 2
