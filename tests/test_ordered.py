import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brewlens import bindings as B
from brewlens.operators import alignment, audit, golden, merkle, signals
from brewlens.operators import timeseries as ts
from brewlens.plans.ordered import PIECE, carry, halo_blocks, ordinals
from brewlens.plans.skew import tenant_scope
from tests.conftest import signal_rows

SPLIT = 200_000_000  # microseconds


@pytest.fixture
def skewed(telemetry):
    r = np.random.default_rng(5)
    parts = [signal_rows("hot", "x", r.normal(size=300), step_seconds=7)]
    parts += [signal_rows(f"b{i}", "x", r.normal(size=9)) for i in range(12)]
    rows = telemetry(*parts).withColumn("value", F.when(F.abs("value") < 1.4, F.col("value")))
    # several readings at one time, so that bucket borders meet ties
    return rows.withColumn("ts", F.date_trunc("minute", "ts"))


def pos():
    return F.unix_micros("ts")


def jobs(spark, build):
    """How many jobs ``build`` starts."""
    name = f"count-{build.__name__}-{id(build)}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_building_a_plan_starts_no_job(spark):
    sf = "/root/testdata/sf0.001"
    telemetry, assay, bands = B.sensors(spark, sf), B.assay(spark, sf), B.phases(spark, sf)
    trail = audit.append_entries(B.audit_input(spark, sf))
    tree = merkle.leaves(audit.with_entry_hash(trail))
    aligned = alignment.align(telemetry, bands)
    grid = alignment.resample(aligned, 720)
    for build in (
        lambda: ts.unified_view(telemetry, assay), lambda: ts.unified_view_per_sensor(telemetry, assay),
        lambda: signals.downsample(signals.auto_penalty(signals.prepare(telemetry)).join(signals.prepare(telemetry), signals.KEYS)),
        lambda: alignment.resample(aligned, 720), lambda: golden.profile_of(grid), lambda: audit.verify_chain(trail),
        lambda: merkle.leaves(audit.with_entry_hash(trail)), lambda: merkle.roots(tree), lambda: merkle.nodes(tree),
    ):
        assert jobs(spark, build) == 0


def test_carry_does_not_depend_on_cuts(skewed):
    rows = skewed.withColumn("id", F.monotonically_increasing_id())
    order = ["ts", "id"]
    args = dict(
        forward={"before": (F.col("value"), False), "upto": (F.col("value"), True)},
        backward={"after": (F.col("value"), False)}, index=True,
    )
    w = Window.partitionBy("batch_id").orderBy(*order)
    expected = rows.withColumns({
        "before": F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "upto": F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.first("value", True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "_i": (F.row_number().over(w) - 1).cast("long"), "_n": F.count("*").over(Window.partitionBy("batch_id")),
    })
    for piece in (SPLIT, 60_000_000, PIECE):
        got = carry(rows, ["batch_id"], order, pos(), piece=piece, **args).select(*expected.columns)
        assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()


def test_null_keys_and_positions(spark):
    rows = spark.createDataFrame(
        [(None, None, 1), (None, 5, 2), (None, 9, 3), ("a", None, 4), ("a", 2, 5), ("a", 2, 6), ("b", 1, 7)], "k string, t long, v int"
    )
    w = Window.partitionBy("k").orderBy("t", "v")
    want = rows.withColumns({"p": F.lag("v").over(w), "_i": (F.row_number().over(w) - 1).cast("long")})
    for piece in (1, 3, PIECE):
        got = carry(rows, ["k"], ["t", "v"], F.col("t"), forward={"p": (F.col("v"), False)}, index=True, piece=piece)
        got = got.select("k", "t", "v", "p", "_i")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_partition_count_does_not_matter(spark, skewed):
    base = ordinals(skewed, ["batch_id"], ["ts", "value"], pos(), SPLIT)
    before = sorted(map(str, base.collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        again = ordinals(skewed, ["batch_id"], ["ts", "value"], pos(), SPLIT)
        assert sorted(map(str, again.collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_signal_preparation_is_the_same_in_blocks(skewed):
    whole = signals.prepare(skewed)
    cut = signals.prepare(skewed, piece=SPLIT, block=16)

    def rounded(df):
        return sorted(str(tuple(r)) for r in df.select(
            "batch_id", "ts", "value", "_i", "_n", F.round("filled", 9), F.round("smoothed", 9)).collect())

    assert rounded(whole) == rounded(cut)


def test_asof_is_the_same_when_split(skewed, spark):
    sensors = skewed.where("value is not null")
    assay = sensors.where("value > 0").select(
        "batch_id", (F.col("ts") + F.expr("interval 20 seconds")).alias("ts"), F.lit("glucose").alias("variable"),
        "value", F.lit(0.1).alias("uncertainty"), F.lit("g/L").alias("unit"), F.lit("HPLC").alias("method"))
    for view in (ts.unified_view, ts.unified_view_per_sensor):
        a, b = view(sensors, assay), view(sensors, assay, SPLIT)
        assert a.count() == assay.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_halo_blocks_cover_every_window(spark):
    rows = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("i"))
    blocks = halo_blocks(rows, "i", 16, 3)
    assert blocks.where("_own").count() == 100
    w = Window.partitionBy("k", "_block").orderBy("i").rowsBetween(-3, 3)
    sums = {r["i"]: r["s"] for r in blocks.withColumn("s", F.sum("i").over(w)).where("_own").collect()}
    assert sums == {i: sum(j for j in range(i - 3, i + 4) if 0 <= j < 100) for i in range(100)}
    with pytest.raises(ValueError):
        halo_blocks(rows, "i", 3, 3)


def test_tenant_scope(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, x int")
    assert tenant_scope(rows, "a").count() == 1
    with pytest.raises(ValueError):
        tenant_scope(rows, "")
