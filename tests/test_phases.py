import numpy as np
import pytest

from brewlens.functions import kernels
from brewlens.operators import phases
from brewlens.plans.ordered import PIECE
from tests.conftest import growth_curve, signal_rows


def test_growth_curve_phases(telemetry):
    rows = telemetry(signal_rows("a", "OD600", growth_curve()), signal_rows("a", "pH", np.zeros(50)),
                     signal_rows("b", "OD600", growth_curve(7, 70)))
    found = phases.detect_phases(rows, phases.DetectionConfig(penalty=5.0)).orderBy("batch_id", "start_ts").collect()
    for batch in ("a", "b"):
        mine = [r for r in found if r["batch_id"] == batch]
        labels = [r["phase_type"] for r in mine]
        assert 3 <= len(mine) <= 6 and "exponential" in labels and "decline" in labels
        assert all(x["end_ts"] == y["start_ts"] for x, y in zip(mine, mine[1:]))
        assert {r["signal_variable"] for r in mine} == {"OD600"} and {r["confidence"] for r in mine} == {1.0}
    assert len({r["annotation_id"] for r in found}) == len(found)


def test_hot_signals_give_the_same_phases(telemetry):
    rows = telemetry(signal_rows("a", "OD600", growth_curve()), signal_rows("b", "OD600", growth_curve(7, 70)[:40]))
    config = phases.DetectionConfig(penalty=5.0)
    one = phases.detect_phases(rows, config)
    cut = phases.detect_phases(rows, config, 600_000_000)
    assert sorted(map(str, one.collect())) == sorted(map(str, cut.collect()))


def smoothed(x):
    padded = np.pad(x, 2, mode="edge")
    return np.array([padded[i:i + 5].mean() for i in range(len(x))])


def steps(n, seed=0):
    levels = np.repeat([0.0, 50.0, 20.0, 80.0], [n // 3, n // 4, n // 6, n - n // 3 - n // 4 - n // 6])
    return levels + np.random.default_rng(seed).normal(0, 0.5, n)


@pytest.mark.parametrize("kernel", ["rbf", "linear"])
@pytest.mark.parametrize("n", [25, 400, 2113])
def test_blocks_find_what_the_exact_kernel_finds(telemetry, n, kernel):
    x = steps(n)
    penalty = 3.0 if kernel == "rbf" else 300.0
    config = phases.DetectionConfig(penalty=penalty, kernel=kernel)
    exact = kernels.kernel_changepoints(smoothed(x), penalty, 10, kernel)
    rows = telemetry(signal_rows("a", "OD600", x))
    for block, halo in ((phases.BLOCK, phases.HALO), (512, 128)):
        got = phases.offline_segments(rows, config, block=block, halo=halo).orderBy("seg").collect()
        assert [r["end_i"] for r in got] == exact
        for r in got:
            assert r["first_value"] == x[r["start_i"]] and r["last_value"] == x[r["end_i"] - 1]


def test_long_signals_are_read_whole(telemetry):
    x = np.zeros(12_000) + np.random.default_rng(1).normal(0, 0.01, 12_000)
    x[7_001:7_041] += 40.0  # forty samples that thinning to 10 000 would blur
    config = phases.DetectionConfig(penalty=3.0, smoothing_window=1)
    got = phases.offline_segments(telemetry(signal_rows("a", "OD600", x)), config).orderBy("seg").collect()
    exact = kernels.kernel_changepoints(x, 3.0, 10)  # over all 12 000 samples at once; it also cuts the noise at 5 629 and 5 825
    assert [r["end_i"] for r in got] == exact and {7_001, 7_041} < set(exact)


def test_signals_across_arrow_batches(spark, telemetry):
    rows = telemetry(*[signal_rows(f"b{i}", "OD600", growth_curve(i)) for i in range(5)])
    config = phases.DetectionConfig(penalty=5.0)
    whole = sorted(map(str, phases.offline_segments(rows, config).collect()))
    online = phases.OnlineConfig(hazard=0.01, threshold=0.3)
    whole_online = sorted(map(str, phases.online_segments(rows, online).collect()))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        assert sorted(map(str, phases.offline_segments(rows, config).collect())) == whole
        assert sorted(map(str, phases.online_segments(rows, online).collect())) == whole_online
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_online_segments_follow_the_detector(telemetry):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.1, 300), r.normal(3, 0.1, 300), r.normal(-3, 0.1, 200)])
    config = phases.OnlineConfig(hazard=0.01, threshold=0.3)
    got = phases.online_segments(telemetry(signal_rows("a", "OD600", x)), config).orderBy("seg").collect()
    p = config.posterior()
    cuts = [i for i, v in enumerate(x) if p.update(v)[0] and i > 0]
    assert [r["start_i"] for r in got] == [0, *cuts]
    assert [r["end_i"] for r in got] == [*cuts, len(x)]
    assert any(300 <= c <= 320 for c in cuts) and any(600 <= c <= 620 for c in cuts)
    labelled = phases.annotations(phases.online_segments(telemetry(signal_rows("a", "OD600", x)), config), "bocpd")
    assert labelled.first()["metadata"]["detection_method"] == "bocpd"


def test_labels(spark):
    rates = [("a", 0, 0, 10, 0.0, 0.1), ("a", 1, 10, 20, 0.1, 9.0), ("a", 2, 20, 30, 9.0, 9.1), ("a", 3, 30, 40, 9.1, 9.0),
             ("a", 4, 40, 41, 9.0, 9.0), ("f", 0, 0, 10, 5.0, 4.0)]
    rows = spark.createDataFrame(
        [(b, "x", s, i, e, None, None, f, l) for b, s, i, e, f, l in rates], phases.SEGMENTS)
    got = {(r["batch_id"], r["seg"]): r["phase_type"] for r in phases.label_segments(rows).collect()}
    assert got == {("a", 0): "lag", ("a", 1): "exponential", ("a", 2): "stationary", ("a", 3): "decline",
                   ("a", 4): "stationary", ("f", 0): "unknown"}


def test_boundary_samples_belong_to_both_phases(spark, telemetry):
    rows = telemetry(signal_rows("a", "x", range(5)))
    t = [r["ts"] for r in rows.orderBy("ts").collect()]
    bands = spark.createDataFrame([("a", "lag", t[0], t[2]), ("a", "exponential", t[2], t[4])],
                                  "batch_id string, phase_type string, start_ts timestamp, end_ts timestamp")
    assert phases.in_phases(rows, bands).count() == 6
    stats = {r["phase_type"]: r["n"] for r in phases.phase_statistics(rows, bands).collect()}
    assert stats == {"lag": 3, "exponential": 3}


def test_hazard_is_checked():
    with pytest.raises(ValueError):
        phases.OnlineConfig(hazard=0.0)


def test_missing_signal_gives_no_phases(telemetry):
    rows = telemetry(signal_rows("a", "pH", range(30)), signal_rows("b", "OD600", [float("nan")] * 30))
    assert phases.detect_phases(rows).isEmpty()
    assert phases.detect_phases(rows, phases.OnlineConfig()).isEmpty()
    assert phases.phase_durations(phases.detect_phases(rows).limit(0)).isEmpty()


@pytest.mark.parametrize("spike", [0.0, 1e4, 1e6, -1e6])
def test_an_outlier_does_not_hide_a_change(telemetry, spike):
    x = np.concatenate([np.zeros(1000), np.full(1000, 50.0)]) + np.random.default_rng(2).normal(0, 0.5, 2000)
    x[400] += spike
    config = phases.DetectionConfig(penalty=2.0, smoothing_window=1)
    exact = kernels.kernel_changepoints(x, 2.0, 10)
    for block, halo in ((phases.BLOCK, phases.HALO), (512, 128)):
        got = phases.offline_segments(telemetry(signal_rows("a", "OD600", x)), config, block=block, halo=halo)
        ends = sorted(r["end_i"] for r in got.collect())
        assert ends == exact and 1000 in ends


@pytest.mark.parametrize("at", [900, 1024, 1333, 2900])
def test_a_weak_shift_is_placed_like_the_exact_kernel_does(telemetry, at):
    x = np.random.default_rng(at).normal(0, 1, 4000)
    x[at:] += 0.45  # too weak for a block of 512 samples, plain over the whole signal
    config = phases.DetectionConfig(penalty=12.0, smoothing_window=1)
    exact = kernels.kernel_changepoints(x, 12.0, 10)
    gamma = 1 / kernels.median_squared_distance(x)
    assert all(len(kernels.kernel_changepoints(x[max(0, b - 128) : b + 640], 12.0, 10, "rbf", gamma)) == 1 for b in range(0, 4000, 512))
    rows = telemetry(signal_rows("a", "OD600", x))
    got = phases.offline_segments(rows, config, block=512, halo=128).orderBy("seg").collect()
    assert len(exact) == len(got) == 2
    assert abs(got[0]["end_i"] - exact[0]) <= config.min_size
    assert got[1]["start_i"] == got[0]["end_i"] and got[1]["start_ts"] == got[0]["end_ts"]
    assert got[1]["first_value"] == x[got[1]["start_i"]] and got[0]["last_value"] == x[got[0]["end_i"] - 1]


@pytest.mark.parametrize("kernel", ["rbf", "linear"])
def test_refined_cut_is_the_cheapest(kernel):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, 90), r.normal(1.5, 1, 110)])
    nodes = np.unique(x)  # sums on these nodes are exact
    gram = kernels.similarity_of(x, x, 0.4, kernel)
    cost = [-gram[:t, :t].sum() / t - gram[t:, t:].sum() / (200 - t) for t in range(60, 140)]
    before, after = kernels.node_weights(x[:60], nodes), kernels.node_weights(x[150:], nodes)
    got = kernels.refined_cut(x[60:150], before, after, 60, 50, nodes, 0.4, kernel, 0, 79, rows=32)
    assert 60 + got == 60 + int(np.argmin(cost))
