"""One query per operator over the benchmark tables. Each reads its tables whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brewlens import bindings as B
from brewlens.functions import scalars as S
from brewlens.operators import alignment, audit, catalog, compliance, golden, lineage, merkle, metrics, phases
from brewlens.operators import query as Q
from brewlens.operators import sensors, signals
from brewlens.operators import timeseries as ts
from brewlens.plans.ordered import ordinals
from brewlens.plans.skew import tenant_scope
from brewlens.session import cut_lineage, ensure_checkpoint_dir, kept
from brewlens.sources import ingest, landed
from brewlens.streaming import online

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def _register(fn: Query) -> Query:
    _ALL[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_ALL)


def us(name: str) -> Column:
    return F.unix_micros(name)


def r6(value: Column | str) -> Column:
    return F.round(value, 6)


# --- catalog ----------------------------------------------------------------------------------------------------


@_register
def batch_search(spark, sf):
    found = catalog.search_batches(B.batches(spark, sf), catalog.BatchFilter(
        strain="1-URGENT", lifecycle="harvested", tags=["scale-up", "BUILDING"],
        inoculation_after="1993-01-01", inoculation_before="1998-01-01",
    ))
    return found.select("batch_id", "name", "meta_operator", us("ts_inoculation").alias("inoculation_us"))


@_register
def name_contains(spark, sf):
    found = catalog.search_batches(B.batches(spark, sf), catalog.BatchFilter(name_contains="run-f-1"))
    return found.select("batch_id", "name", "lifecycle")


@_register
def media_and_operator(spark, sf):
    found = catalog.search_batches(B.batches(spark, sf), catalog.BatchFilter(
        media="MACHINERY", operator="Customer#000000001"))
    return found.select("batch_id", "meta_media", "meta_operator")


@_register
def time_range(spark, sf):
    rows = ts.time_range(B.telemetry(spark, sf), "2024-01-10 00:00:00", "2024-01-13 00:00:00")
    return rows.select("batch_id", us("ts").alias("ts_us"), "variable", "value", "unit")


@_register
def one_batch_scan(spark, sf):
    rows = ts.of_variables(ts.of_batch(B.telemetry(spark, sf), "7"), ["click", "view"])
    return rows.select("batch_id", us("ts").alias("ts_us"), "variable", "value")


@_register
def topk_batches(spark, sf):
    return (
        Q.BatchQuery(Q.Views(B.batches(spark, sf)))
        .select("batch_id", "name", "scale_liters").order_by("scale_liters", descending=True).limit(10).to_df()
        .select("batch_id", "name", r6("scale_liters").alias("scale_liters"))
    )


@_register
def newest_batches(spark, sf):
    return catalog.newest_first(B.batches(spark, sf), limit=20, offset=20).select(
        "batch_id", us("created_at").alias("created_us"))


@_register
def ranked_first(spark, sf):
    return catalog.first_ranked(B.batches(spark, sf), F.col("meta_scale_liters").asc(), 5).select("batch_id")


@_register
def group_by_strain(spark, sf):
    scale = Q.field("scale_liters")
    return (
        Q.BatchQuery(Q.Views(B.batches(spark, sf)))
        .select(
            "strain", "lifecycle", Q.agg("count").named("n"), Q.agg("avg", scale).named("mean_scale"),
            Q.agg("min", scale).named("min_scale"), Q.agg("max", scale).named("max_scale"),
            Q.agg("sum", scale).named("sum_scale"),
        ).group_by("strain", "lifecycle").to_df()
        .select("strain", "lifecycle", "n", *[r6(c).alias(c) for c in (
            "mean_scale", "min_scale", "max_scale", "sum_scale")])
    )


@_register
def bracket_filter(spark, sf):
    q = Q.BatchQuery(Q.Views(B.batches(spark, sf))).batches(where=Q.field("lifecycle") == "running")
    q = q.select("batch_id", "strain", "media").where(
        (Q.field("strain").like("%URGENT%") | (Q.field("scale_liters") > 450)) & ~(Q.field("media") == "BUILDING"))
    return q.to_df()


@_register
def single_batch_query(spark, sf):
    q = Q.BatchQuery(Q.Views(B.batches(spark, sf))).batch("42").select("batch_id", "name", "operator")
    return q.to_df()


@_register
def rejected_rows(spark, sf):
    """Rows of the catalog and of telemetry that break a rule (limits moved so that some do)."""
    shifted = B.batches(spark, sf).withColumn("meta_scale_liters", F.col("meta_scale_liters") - 100)
    _, bad = catalog.validate_batches(shifted)
    broken = B.telemetry(spark, sf).withColumn(
        "value", F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value")))
    _, bad_rows = catalog.validate_telemetry(broken)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(
        bad_rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


def _changes(spark, sf) -> DataFrame:
    b = B.batches(spark, sf)
    return b.where("lifecycle = 'running'").withColumns({
        "lifecycle": F.lit("harvested"), "updated_at": F.expr("updated_at + interval 1 day")})


@_register
def updated_catalog(spark, sf):
    """Catalog after updating the running batches, by replacing rows."""
    after = catalog.upsert(B.batches(spark, sf), _changes(spark, sf))
    return after.select("batch_id", "lifecycle", us("updated_at").alias("updated_us"))


@_register
def catalog_log(spark, sf):
    """The same update, then deleting the large batches, as change-log versions."""
    base = B.batches(spark, sf)
    log = catalog.log_rows(base, 1).unionByName(catalog.log_rows(_changes(spark, sf), 2)).unionByName(
        catalog.log_rows(base.where("meta_scale_liters > 400"), 3, deleted=True))
    return catalog.current_batches(log).select("batch_id", "lifecycle", us("updated_at").alias("updated_us"))


@_register
def nested_round_trip(spark, sf):
    flat = catalog.to_flat(catalog.to_nested(catalog.from_json_text(catalog.to_json_text(B.batches(spark, sf)))))
    return flat.select("batch_id", "meta_strain", F.array_join("tags", "|").alias("tags"))


@_register
def duplicate_batches(spark, sf):
    b = B.batches(spark, sf)
    incoming = b.where("lifecycle = 'planned'").unionByName(b.where("meta_scale_liters > 450"))
    return catalog.duplicate_ids(b.where("lifecycle = 'running'"), incoming)


# --- telemetry and assays ------------------------------------------------------------------------------------------


_VIEW = ["batch_id", "analyte", "assay_value", "assay_uncertainty", "assay_unit", "assay_method", "sensor",
         "sensor_value", "sensor_unit"]


def _unified(df: DataFrame) -> DataFrame:
    return df.select(*_VIEW, us("assay_ts").alias("assay_us"), us("telemetry_ts").alias("telemetry_us")).withColumn(
        "assay_uncertainty", r6("assay_uncertainty"))


@_register
def asof_unified(spark, sf):
    return _unified(ts.unified_view(B.sensors(spark, sf), B.assay(spark, sf)))


@_register
def asof_per_sensor(spark, sf):
    return _unified(ts.unified_view_per_sensor(B.sensors(spark, sf), B.assay(spark, sf)))


@_register
def telemetry_union_assay(spark, sf):
    rows = ts.union_assay(B.sensors(spark, sf), B.assay(spark, sf))
    return rows.groupBy("batch_id", "variable", "unit", "method").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"), r6(F.sum("uncertainty")).alias("sigma_total"))


@_register
def batch_summary(spark, sf):
    rows = ts.batch_summary(B.telemetry(spark, sf), B.BIOMASS, B.OXYGEN)
    return rows.select("batch_id", "n_points", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"),
                       "n_variables", "max_biomass", "min_oxygen")


@_register
def compare_batches(spark, sf):
    return ts.compare_batches(B.telemetry(spark, sf)).withColumn("mean", r6("mean"))


@_register
def daily_means(spark, sf):
    """Duplicates at one (batch, variable, day) averaged."""
    rows = B.telemetry(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    return ts.mean_of_duplicates(rows, ["day"]).select(
        "batch_id", "variable", us("day").alias("day_us"), r6("value").alias("value"))


@_register
def pivot_sensors(spark, sf):
    wide = ts.pivot_first(B.telemetry(spark, sf), ["click", "error", "purchase", "signup", "view"])
    return wide.select("batch_id", us("ts").alias("ts_us"), "click", "error", "purchase", "signup", "view")


@_register
def zscore(spark, sf):
    return ts.zscores(B.telemetry(spark, sf)).select(
        "batch_id", "variable", us("ts").alias("ts_us"), "value", r6("z").alias("z"))


@_register
def missing_inputs(spark, sf):
    """Variables a batch lacks on the days of the first week."""
    rows = B.telemetry(spark, sf).select(
        F.concat_ws("/", "batch_id", F.date_format("ts", "yyyy-MM-dd")).alias("batch_id"), "variable")
    return ts.missing_variables(rows, ["click", "view"])


# --- phases and metrics ----------------------------------------------------------------------------------------------


@_register
def phase_duration(spark, sf):
    q = Q.BatchQuery(Q.Views(B.batches(spark, sf), phases=B.phases(spark, sf)))
    rows = q.select(
        "batch_id", "strain", Q.phase_duration("exponential").named("exp_hours"),
        Q.phase_duration("lag").named("lag_hours"),
    ).where(Q.phase_duration("exponential") > 1).to_df()
    return rows.withColumns({"exp_hours": r6("exp_hours"), "lag_hours": r6("lag_hours")})


@_register
def phase_join_stats(spark, sf):
    return phases.phase_statistics(B.telemetry(spark, sf), B.phases(spark, sf)).withColumn("mean", r6("mean"))


def _metrics(spark, sf) -> DataFrame:
    return metrics.batch_metrics(B.telemetry(spark, sf), B.phases(spark, sf), B.BIOMASS, B.PRODUCT, B.SUBSTRATE)


@_register
def batch_metrics(spark, sf):
    m = _metrics(spark, sf)
    return m.select("batch_id", "phase_type", us("start_ts").alias("start_us"),
                    *[F.round(c, 5).alias(c) for c in ("mu", "r_squared", "qp", "yx_s", "yp_s")])


@_register
def growth_rate_by_strain(spark, sf):
    """Mean exponential growth rate per strain: telemetry, phases, metrics and catalog together."""
    q = Q.BatchQuery(Q.Views(B.batches(spark, sf), metrics=_metrics(spark, sf)))
    rows = q.select(
        "strain", Q.agg("avg", Q.growth_rate()).named("mean_mu"), Q.agg("count", Q.growth_rate()).named("n_mu"),
        Q.agg("count").named("n_batches"),
    ).group_by("strain").to_df()
    return rows.withColumn("mean_mu", r6("mean_mu"))


@_register
def yield_query(spark, sf):
    q = Q.BatchQuery(Q.Views(B.batches(spark, sf), metrics=_metrics(spark, sf)))
    rows = q.select("batch_id", Q.yield_coefficient().named("yx_s")).where(Q.yield_coefficient() != 0).to_df()
    return rows.withColumn("yx_s", F.round("yx_s", 5))


@_register
def growth_rates(spark, sf):
    rows = B.telemetry(spark, sf).where(F.col("variable") == B.BIOMASS).withColumn(
        "h", us("ts").cast("double") / 3.6e9 - 473352)
    out = metrics.growth_rates(rows, ["batch_id"], F.col("h"), F.col("value"))
    return out.select("batch_id", r6("mu").alias("mu"), r6("r_squared").alias("r_squared"),
                      r6("std_error").alias("std_error"), "n")


@_register
def productivity(spark, sf):
    return metrics.productivity(B.telemetry(spark, sf), ["batch_id", "variable"]).withColumn("qp", r6("qp"))


@_register
def yield_uncertainty(spark, sf):
    rows = B.telemetry(spark, sf).withColumn("uncertainty", F.col("value") * 0.05)
    out = metrics.yields_with_uncertainty(rows, B.SUBSTRATE, B.BIOMASS)
    return out.select("batch_id", F.round("yield", 5).alias("yield"), F.round("sigma", 4).alias("sigma"))


def _quarter_segments(spark, sf) -> DataFrame:
    rows = B.activity(spark, sf)
    numbered = ordinals(rows, signals.KEYS, ["ts", "value"], us("ts"))
    seg = F.floor(F.col("_i") * 4 / F.col("_n")).cast("int")
    rank = F.struct("_i", "value")
    return numbered.groupBy(*signals.KEYS, seg.alias("seg")).agg(
        F.min("_i").alias("start_i"), (F.max("_i") + 1).alias("end_i"), F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"), F.min_by("value", rank).alias("first_value"),
        F.max_by("value", rank).alias("last_value"))


@_register
def label_segments(spark, sf):
    return phases.label_segments(_quarter_segments(spark, sf)).select(
        "batch_id", "seg", r6("growth_rate").alias("growth_rate"), "phase_type")


@_register
def pelt_phases(spark, sf):
    found = phases.detect_phases(B.activity(spark, sf), phases.DetectionConfig("activity", min_size=5, penalty=2.0))
    return found.select("batch_id", "phase_type", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"),
                        r6(F.col("metadata")["growth_rate"].cast("double")).alias("growth_rate"))


@_register
def pelt_long_signals(spark, sf):
    found = phases.detect_phases(B.long_signals(spark, sf), phases.DetectionConfig("activity"))
    return found.select("batch_id", "phase_type", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"))


@_register
def online_phases(spark, sf):
    found = phases.detect_phases(B.activity(spark, sf), phases.OnlineConfig("activity", hazard=1 / 250, threshold=0.3))
    return found.select("batch_id", "phase_type", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"))


def _cover(segments: DataFrame) -> DataFrame:
    """Rows from the first to the last sample of each signal, and how many of its segments do not begin where one ends."""
    n = segments.groupBy("batch_id").agg(
        F.sum(F.col("end_i") - F.col("start_i")).alias("n"), F.max("end_i").alias("upto"),
        us(F.min("start_ts")).alias("first_us"), us(F.max("end_ts")).alias("last_us"))
    ends = segments.select("batch_id", F.col("end_i").alias("start_i"))
    loose = segments.where("start_i > 0").join(ends, ["batch_id", "start_i"], "left_anti").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("gaps"))
    return n.join(loose, "batch_id", "left").select(
        "batch_id", "n", "upto", "first_us", "last_us", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))


@_register
def pelt_cover(spark, sf):
    """Offline segments of each signal cover every sample once."""
    return _cover(cut_lineage(phases.offline_segments(
        B.activity(spark, sf), phases.DetectionConfig("activity", min_size=5, penalty=2.0))))


@_register
def online_cover(spark, sf):
    """Online segments of each signal cover every sample once."""
    return _cover(cut_lineage(phases.online_segments(
        B.activity(spark, sf), phases.OnlineConfig("activity", hazard=1 / 250, threshold=0.3))))


@_register
def detected_metrics(spark, sf):
    """Detection and metrics; the metrics meet the phases twice, which are found and kept once."""
    rows = B.activity(spark, sf)
    found = kept(phases.detect_phases(rows, phases.DetectionConfig("activity", min_size=5, penalty=2.0)), "phases")
    m = metrics.batch_metrics(rows, found, "activity")
    return m.select("batch_id", "phase_type", us("start_ts").alias("start_us"), r6("mu").alias("mu"))


# --- signals -----------------------------------------------------------------------------------------------------------


def _faulty(spark, sf) -> DataFrame:
    """Telemetry in which readings above 60 are sensor faults (NaN)."""
    return B.telemetry(spark, sf).withColumn(
        "value", F.when(F.col("value") > 60, F.lit(float("nan"))).otherwise(F.col("value")))


@_register
def gap_fill(spark, sf):
    rows = signals.prepare(_faulty(spark, sf))
    return rows.select("batch_id", "variable", us("ts").alias("ts_us"), r6("filled").alias("filled"))


@_register
def smooth(spark, sf):
    rows = signals.prepare(_faulty(spark, sf))
    return rows.select("batch_id", "variable", us("ts").alias("ts_us"), r6("smoothed").alias("smoothed"))


@_register
def downsample(spark, sf):
    rows = signals.downsample(signals.prepare(B.activity(spark, sf)), max_samples=10)
    return rows.select("batch_id", F.col("_k").alias("k"), us("ts").alias("ts_us"), "value")


@_register
def auto_penalty(spark, sf):
    rows = signals.auto_penalty(signals.prepare(B.telemetry(spark, sf)))
    return rows.select("batch_id", "variable", "n", r6("penalty").alias("penalty"))


# --- alignment and golden batches -----------------------------------------------------------------------------------------


def _aligned(spark, sf, variables=None) -> DataFrame:
    return alignment.align(B.telemetry(spark, sf), B.phases(spark, sf), "exponential", variables)


@_register
def align_long(spark, sf):
    return _aligned(spark, sf).select("batch_id", "variable", "elapsed_us", r6("value").alias("value"))


@_register
def align_grid(spark, sf):
    grid = alignment.resample(_aligned(spark, sf, ["click", "view"]), 720)
    return grid.select("batch_id", "variable", "elapsed_us", r6("value").alias("value"))


@_register
def align_wide(spark, sf):
    rows = B.long_signals(spark, sf)
    starts = rows.groupBy("batch_id").agg(F.min("ts").alias("start_ts")).withColumn("phase_type", F.lit("exponential"))
    grid = alignment.resample(alignment.align(rows, starts), 360)
    names = [f"{k}__activity" for k in ("click", "error", "purchase", "signup", "view")]
    wide = alignment.to_wide(grid, names)
    return wide.select(r6("elapsed_hours").alias("elapsed_hours"), *[r6(n).alias(n) for n in names])


@_register
def golden_profile(spark, sf):
    profile = golden.profile_of(alignment.resample(_aligned(spark, sf, ["click", "view"]), 720))
    return golden.envelope(profile).select(
        "variable", "elapsed_us", "n_batches", *[r6(c).alias(c) for c in ("mean", "std", "lower", "upper")])


@_register
def dtw_scores(spark, sf):
    """Every run against the mean run, on a 12-hour grid."""
    grid = cut_lineage(alignment.resample(_aligned(spark, sf, ["click"]), 720))  # used for profile and runs
    return golden.score_batches(grid, golden.profile_of(grid), ["click"], time="elapsed_us").drop("error")


@_register
def golden_score_query(spark, sf):
    grid = cut_lineage(alignment.resample(_aligned(spark, sf, ["click"]), 720))
    scores = golden.score_batches(grid, golden.profile_of(grid), ["click"], time="elapsed_us")
    q = Q.BatchQuery(Q.Views(B.batches(spark, sf), scores=scores))
    return q.select("strain", Q.agg("max", Q.golden_score("golden")).named("best"), Q.agg("count").named("n")).group_by(
        "strain").to_df()


@_register
def phase_overlay(spark, sf):
    p = B.phases(spark, sf)
    return phases.phase_bands(p, alignment.anchors(p)).select(
        "batch_id", "phase_type", r6("start_hours").alias("start_hours"), r6("end_hours").alias("end_hours"))


# --- soft sensors ------------------------------------------------------------------------------------------------------------


@_register
def linear_sensor(spark, sf):
    found = sensors.apply_sensor(sensors.LinearSensor("click", "biomass_est", 2.0, 0.5, 0.25), B.telemetry(spark, sf))
    return found.select("batch_id", us("ts").alias("ts_us"), "variable", r6("value").alias("value"), "uncertainty",
                        "source")


class _LogSensor(sensors.Sensor):
    output_variable = "log_est"
    input_variables = ("view",)

    def predict(self, inputs, timestamps):
        values = np.log1p(inputs["view"]) * 3.0
        return values, values * 0.0 + 0.1


@_register
def model_sensor(spark, sf):
    found = sensors.apply_sensor(_LogSensor(), B.telemetry(spark, sf))
    return found.select("batch_id", us("ts").alias("ts_us"), "variable", r6("value").alias("value"), "uncertainty")


@_register
def with_predictions(spark, sf):
    t = B.telemetry(spark, sf)
    both = sensors.with_predictions(t, sensors.apply_sensor(sensors.LinearSensor("click", "est", 2.0, 0.5), t))
    return both.groupBy("batch_id", "variable", "source").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@_register
def sensor_records(spark, sf):
    """All records with their own inputs in one pass."""
    found = sensors.apply_records(B.sensor_records(spark, sf), B.daily(spark, sf), {"log": _LogSensor()})
    return found.select("sensor_id", "batch_id", us("ts").alias("ts_us"), "variable", r6("value").alias("value"),
                        r6("uncertainty").alias("uncertainty"), "source")


@_register
def custom_sensor_records(spark, sf):
    """Records that name a Python model next to weighted ones."""
    kind = F.when(F.col("model_type") == "spline", "custom").otherwise(F.col("model_type"))
    records = B.sensor_records(spark, sf).withColumns({
        "model_type": kind, "metadata": F.create_map(F.lit("model"), F.lit("log")),
        "input_variables": F.when(kind == "custom", F.array(F.lit("view"))).otherwise(F.col("input_variables")),
    })
    found = sensors.apply_records(records, B.daily(spark, sf), {"log": _LogSensor()})
    return found.groupBy("sensor_id", "variable").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@_register
def sensor_issues(spark, sf):
    return sensors.record_issues(B.sensor_records(spark, sf, "supplier"))


# --- ingestion -----------------------------------------------------------------------------------------------------------------


def _raw_rows(spark, sf) -> DataFrame:
    """Order lines as rows of raw text files: one file per (return flag, line status).

    Times come in three layouts, tax is blank on first lines, and some quantities are not numbers.
    """
    line = B.table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    day = F.col("l_shipdate")
    when = F.when(n == 1, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(
        n == 2, F.date_format(day, "MM/dd/yyyy HH:mm")).otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return line.select(
        F.concat("l_returnflag", "l_linestatus").alias("source"), "l_orderkey", n.alias("n"), "l_partkey",
        F.array(
            when, F.when(n == 7, "n/a").otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" "))),
            F.col("l_extendedprice").cast("string"), F.col("l_discount").cast("string"),
            F.when(n == 1, "").otherwise(F.col("l_tax").cast("string")),
        ).alias("fields"),
    )


_HEADER = ["timestamp", "glucose_mg_L", "temp_K", "vol_mL", "pH"]


def _raw_plan(spark, rows: DataFrame) -> DataFrame:
    """Column plan from the header and all rows of each file."""
    header = rows.select("source").distinct().select(
        "source", F.lit(0).alias("rn"), F.array(*[F.lit(h) for h in _HEADER]).alias("fields"))
    body = rows.select("source", ingest.position(F.col("l_orderkey"), F.col("n")).alias("pos"), "fields")
    return ingest.plan_columns(header, body)


@_register
def melt_units(spark, sf):
    """Wide text rows melted, parsed and converted to canonical units, totals per file, variable and day."""
    rows = _raw_rows(spark, sf)
    records, _ = ingest.melt(rows.select("source", "fields"), _raw_plan(spark, rows), F.lit(None).cast("timestamp"))
    return records.groupBy("source", "variable", "unit", us("ts").alias("ts_us")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@_register
def column_plan(spark, sf):
    plan = _raw_plan(spark, _raw_rows(spark, sf))
    return plan.select("source", "col_no", "header", "is_ts", "variable", "confidence", "unit", "from_unit")


@_register
def quality_flags(spark, sf):
    line = B.table(spark, sf, "lineitem").select(
        F.lit("ph").alias("variable"), (F.col("l_quantity") - 10).alias("value"))
    return line.groupBy("value", S.quality_flag(F.col("variable"), F.col("value")).alias("flag")).agg(
        F.count(F.lit(1)).alias("n"))


@_register
def unit_by_range(spark, sf):
    """Unit guessed per part from the mean of its readings."""
    means = B.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"), F.avg("l_discount").alias("d"))
    glucose, temp = F.lit("glucose"), F.lit("temperature")
    return means.select(
        "l_partkey", S.range_unit(glucose, F.col("p") / 50).alias("by_price"),
        S.range_unit(temp, F.col("q") * 8).alias("by_quantity"), S.range_unit(glucose, F.col("d") * 2).alias("by_discount"))


@_register
def unit_conversion(spark, sf):
    line = B.table(spark, sf, "lineitem")
    value = F.col("l_extendedprice")
    out = {
        "g_l": S.convert_unit(value, F.lit("mg/L"), F.lit("g/L")), "celsius": S.convert_unit(value, F.lit("F"), F.lit("C")),
        "hours": S.convert_unit(value, F.lit("min"), F.lit("h")), "molar": S.convert_unit(value, F.lit("mol/L"), F.lit("g/L")),
    }
    return line.groupBy("l_returnflag").agg(*[F.round(F.sum(c), 2).alias(n) for n, c in out.items()])


@_register
def elapsed_to_time(spark, sf):
    line = B.table(spark, sf, "lineitem")
    at = S.elapsed_to_timestamp(F.col("l_quantity") + F.col("l_tax"), S.elapsed_unit(F.lit("time_min")),
                                F.col("l_shipdate").cast("timestamp"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", us(at).alias("ts_us"))


@_register
def text_timestamps(spark, sf):
    rows = _raw_rows(spark, sf)
    parsed = S.parse_timestamp(F.get("fields", F.lit(0)))
    return rows.groupBy("n", us(parsed).alias("ts_us")).agg(F.count(F.lit(1)).alias("rows"))


# --- landed extracts --------------------------------------------------------------------------------------------------------------


def _points(spark, sf) -> DataFrame:
    return B.events(spark, sf).select(
        F.col("ts").alias("_time"), F.lit("reactor").alias("_measurement"), F.col("event_type").alias("_field"),
        F.col("value").alias("_value"), F.col("user_id").cast("string").alias("reactor_id"))


_MAPPING = landed.SourceMapping("_time", (
    landed.FieldMapping("click", "biomass", "mg/L"), landed.FieldMapping("error", "temperature", "K"),
    landed.FieldMapping("view", "ph", None, "multiply:0.1"), landed.FieldMapping("nothing", "lactate", "g/L"),
))


@_register
def historian_pull(spark, sf):
    """Range and field selection, pivot to one column per field, mapping with transforms and units."""
    chosen = landed.select_points(_points(spark, sf), "reactor", ["click", "error", "view"],
                                  "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    wide = landed.pivot_fields(chosen, ["click", "error", "view"], ["reactor_id"])
    rows = landed.wide_to_telemetry(wide, _MAPPING, F.col("reactor_id"), normalise=True)
    return rows.select("batch_id", us("ts").alias("ts_us"), "variable", r6("value").alias("value"), "unit")


@_register
def missing_points(spark, sf):
    mapping = landed.SourceMapping("_time", (*_MAPPING.variables, landed.FieldMapping("signup", "feed", None)))
    return landed.missing_points(_points(spark, sf), mapping, "_field")


@_register
def point_readings(spark, sf):
    """Per-point reading lists as telemetry."""
    item = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("Timestamp"),
                    F.col("value").cast("string").alias("Value"))
    rows = B.events(spark, sf).select(
        F.col("user_id").cast("string").alias("b"), F.col("event_type").alias("point"), F.array(item).alias("Items"))
    out = landed.points_to_telemetry(rows, _MAPPING, F.col("b"))
    return out.select("batch_id", us("ts").alias("ts_us"), "variable", r6("value").alias("value"), "unit")


_RESULTS = landed.SourceMapping("analysis_date", (
    landed.FieldMapping("titer", "titer", "g/L"), landed.FieldMapping("vcd", "viable_cell_density", None)))


@_register
def lims_results(spark, sf):
    o = B.table(spark, sf, "orders")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("b"),
        F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("analysis_date"),
        F.when(F.col("o_orderpriority") == "5-LOW", "low").otherwise(F.col("o_totalprice").cast("string")).alias("titer"),
        (F.col("o_totalprice") / 10).alias("vcd"), F.lit("cells").alias("unit"))
    good, _ = landed.results_to_assay(rows, _RESULTS, F.col("b"))
    return good.groupBy("batch_id", "variable", "unit", "method").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"), us(F.max("ts")).alias("last_us"))


def _notebook(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = B.table(spark, sf, "orders")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("b"),
        F.when(F.col("o_orderstatus") == "O", "titer").otherwise(F.col("o_orderpriority")).alias("name"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.concat(F.lit("note "), F.col("o_orderkey")))
        .otherwise(F.col("o_totalprice").cast("string")).alias("value"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    return landed.notebook_results(rows, landed.SourceMapping.default("scinote"), F.col("b"))


@_register
def notebook_assays(spark, sf):
    return _notebook(spark, sf)[0].groupBy("batch_id", "variable", "unit", "method").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@_register
def notebook_observations(spark, sf):
    return _notebook(spark, sf)[1].select("batch_id", F.explode("observations").alias("name", "text"))


# --- lineage ------------------------------------------------------------------------------------------------------------------------


@_register
def lineage_down(spark, sf):
    return lineage.descendants(B.operations(spark, sf))


@_register
def lineage_up(spark, sf):
    return lineage.ancestors(B.operations(spark, sf))


@_register
def lineage_rings(spark, sf):
    """Ten conversations as one ring of operations: ways cross batches and come back to their start."""
    c = B.table(spark, sf, "conversations").withColumn("ring", F.floor(F.col("conv_id") / 10))
    along = Window.partitionBy("ring").orderBy("conv_id", "turn")
    oid = F.concat_ws(":", "conv_id", "turn")
    last = F.last(oid).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = c.select(
        oid.alias("operation_id"), F.col("conv_id").cast("string").alias("batch_id"),
        F.array(F.coalesce(F.lag(oid).over(along), last)).alias("parent_ids"))
    return lineage.descendants(rows, across_batches=True)


# --- audit --------------------------------------------------------------------------------------------------------------------------


@_register
def entry_hashes(spark, sf):
    rows = B.audit_input(spark, sf).withColumn("previous_entry_hash", F.lit(""))
    return audit.with_entry_hash(rows).select("tenant_id", "seq", "entry_hash")


@_register
def chain_append(spark, sf):
    return audit.append_entries(B.audit_input(spark, sf)).select(
        "tenant_id", "seq", "previous_entry_hash", "record_hash")


def _tampered(spark, sf) -> DataFrame:
    chain = cut_lineage(audit.append_entries(B.audit_input(spark, sf)))  # a stored trail
    edited = (F.col("action") == "sign") & (F.col("new_value_hash") < "8")
    return chain.withColumn("reason", F.when(edited, "edited").otherwise(F.col("reason")))


@_register
def chain_verify(spark, sf):
    return audit.verify_chain(_tampered(spark, sf)).select("tenant_id", "seq", "chain_ok", "stored_link_ok", "content_ok")


@_register
def chain_verdict(spark, sf):
    return audit.chain_verdict(_tampered(spark, sf))


@_register
def last_hashes(spark, sf):
    return audit.last_hashes(audit.append_entries(B.audit_input(spark, sf)))


@_register
def audit_page(spark, sf):
    return audit.list_entries(B.audit_input(spark, sf), "update", limit=25, offset=25).select(
        "tenant_id", "seq", us("timestamp").alias("timestamp_us"))


@_register
def tenant_rows(spark, sf):
    return tenant_scope(B.audit_input(spark, sf), "7").select("tenant_id", "seq", "action")


@_register
def field_completeness(spark, sf):
    rows = audit.missing_fields(B.audit_input(spark, sf), ["old_value_hash", "new_value_hash", "user_id", "reason"])
    return rows.select("tenant_id", "seq", "field")


@_register
def format_issues(spark, sf):
    rows = B.audit_input(spark, sf).withColumns({
        "entry_id": F.when(F.col("seq") == 3, "x").otherwise(F.col("entry_id")),
        "action": F.when(F.col("seq") == 5, "approve").otherwise(F.col("action"))})
    return audit.format_issues(rows).select("tenant_id", "seq", "issue")


@_register
def role_violations(spark, sf):
    return audit.role_violations(B.audit_input(spark, sf), B.users(spark, sf)).select(
        "tenant_id", "seq", "user_id", "permission")


@_register
def compliance_report(spark, sf):
    return compliance.report(_tampered(spark, sf), B.users(spark, sf)).select(
        "item_no", "item_id", "regulation", "section", "status")


@_register
def compliance_overall(spark, sf):
    return compliance.overall(compliance.report(_tampered(spark, sf), B.users(spark, sf), "EU_Annex_11"))


@_register
def table_fingerprint(spark, sf):
    rows = B.table(spark, sf, "orders").withColumn("price", F.format_string("%.2f", "o_totalprice"))
    return audit.tamper_free_fingerprint(rows, ["o_orderkey", "o_custkey", "o_orderstatus", "price"])


@_register
def record_fingerprints(spark, sf):
    return B.batches(spark, sf).select(
        "batch_id", S.row_fingerprint(F.col("batch_id"), F.col("name"), F.col("lifecycle")).alias("fingerprint"))


# --- Merkle trees ----------------------------------------------------------------------------------------------------------------------


def _tree(spark, sf, one_tree: bool) -> DataFrame:
    rows = B.audit_input(spark, sf).withColumn("previous_entry_hash", F.lit(""))
    hashed = audit.with_entry_hash(rows)
    if one_tree:
        hashed = hashed.withColumns({
            "seq": F.col("tenant_id").cast("long") * 1000 + F.col("seq"), "tenant_id": F.lit("all")})
    return merkle.leaves(hashed)


@_register
def merkle_leaves(spark, sf):
    return _tree(spark, sf, True).select("idx", "size", F.lower(F.hex("hash")).alias("hash"))


@_register
def merkle_root(spark, sf):
    """Root over all entries as one tree, and the root of each conversation's tree."""
    return merkle.roots(_tree(spark, sf, True)).unionByName(merkle.roots(_tree(spark, sf, False)))


@_register
def merkle_nodes(spark, sf):
    return merkle.nodes(_tree(spark, sf, True)).select("level", "idx", F.lower(F.hex("hash")).alias("hash"))


@_register
def inclusion_proofs(spark, sf):
    tree = _tree(spark, sf, True)
    return merkle.inclusion_proofs(tree, merkle.nodes(tree)).select(
        "idx", "level", "side", F.lower(F.hex("hash")).alias("hash"))


@_register
def inclusion_verified(spark, sf):
    tree = _tree(spark, sf, False)
    proofs = merkle.inclusion_proofs(tree, merkle.nodes(tree))
    return merkle.verify_inclusion(tree, proofs, merkle.roots(tree))


@_register
def consistency_verified(spark, sf):
    """Each conversation's tree without its last turn is a prefix of the whole tree."""
    tree = _tree(spark, sf, False)
    new = merkle.roots(tree).select("tenant_id", F.col("size").alias("new_size"), F.col("root").alias("new_root"))
    before = tree.where("idx < size - 1").withColumn("size", F.col("size") - 1)
    old = merkle.roots(before).select("tenant_id", F.col("size").alias("old_size"), F.col("root").alias("old_root"))
    roots_at = old.join(new, "tenant_id")
    proofs = merkle.consistency_proofs(roots_at.select("tenant_id", "old_size", "new_size"), merkle.nodes(tree))
    return merkle.verify_consistency(proofs, roots_at)


@_register
def consistency_cases(spark, sf):
    """Each conversation's tree against itself, against an altered older root, and against a log that was longer."""
    tree = cut_lineage(_tree(spark, sf, False))
    nodes = cut_lineage(merkle.nodes(tree))
    new = merkle.roots(tree).select("tenant_id", F.col("size").alias("new_size"), F.col("root").alias("new_root"))
    out = None
    for case, old_size in (("equal", F.col("new_size")), ("altered", F.col("new_size") - 1), ("shrunk", F.col("new_size") + 1)):
        old_root = F.reverse("new_root") if case == "altered" else F.col("new_root")
        roots_at = new.select("tenant_id", old_size.alias("old_size"), "new_size", old_root.alias("old_root"), "new_root")
        proofs = merkle.consistency_proofs(roots_at.select("tenant_id", "old_size", "new_size"), nodes)
        judged = merkle.verify_consistency(proofs, roots_at).withColumn("case", F.lit(case))
        out = judged if out is None else out.unionByName(judged)
    return out


@_register
def checkpoint_check(spark, sf):
    """Stored roots against rebuilt trees; the checkpoints of the longest conversations were altered."""
    tree = _tree(spark, sf, False)
    stored = merkle.roots(tree).withColumn("root", F.when(F.col("size") >= 8, F.reverse("root")).otherwise(F.col("root")))
    return merkle.check_against(tree, stored)


def _two_parts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frontiers over the first three leaves of each tree, the leaves behind them, and the whole tree."""
    tree = cut_lineage(_tree(spark, sf, False))
    return cut_lineage(merkle.frontiers(tree.where("idx < 3"))), tree.where("idx >= 3"), tree


@_register
def frontier_roots(spark, sf):
    """Roots of trees that grew from stored frontiers."""
    first, rest, _ = _two_parts(spark, sf)
    return merkle.frontier_roots(merkle.frontiers(rest, first))


@_register
def frontier_check(spark, sf):
    """Grown logs against claimed roots; those of the longest conversations were altered."""
    first, rest, tree = _two_parts(spark, sf)
    claimed = merkle.roots(tree).withColumn("root", F.when(F.col("size") >= 8, F.reverse("root")).otherwise(F.col("root")))
    return merkle.check_growth(first, rest, claimed)


# --- streaming ---------------------------------------------------------------------------------------------------------------------------


def _streamed(spark, sf) -> DataFrame:
    """Online changepoints of every user's signal as a stream that ends when the stored events are read."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/online-{uuid.uuid4().hex}"
    schema = B.table(spark, sf, "events").schema
    # A stream reads folders: the table's own, or the one that holds its single file.
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/events.parquet")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        source = reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    else:
        source = reader.parquet(f"{sf}/events.parquet")
    signal = source.select(
        F.col("user_id").cast("string").alias("batch_id"), F.lit("activity").alias("variable"),
        F.col("ts").cast("timestamp").alias("ts"), "value")
    run = (
        online.detect_online(signal, phases.OnlineConfig("activity")).writeStream.format("parquet")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@_register
def online_stream(spark, sf):
    return _streamed(spark, sf).select(
        "batch_id", us("ts").alias("ts_us"), "value", "detected", r6("short_mass").alias("short_mass"))


@_register
def stream_equals_batch(spark, sf):
    """Values of each signal, and changepoints that only the stream or only the batch detector finds."""
    out = _streamed(spark, sf)
    n = out.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("begin"), us(F.max("ts")).alias("last_us"))
    segments = cut_lineage(phases.online_segments(B.activity(spark, sf), phases.OnlineConfig("activity")))
    batch = segments.where("start_i > 0").select("batch_id", F.col("start_ts").alias("ts"))
    stream = out.where("detected").join(n.select("batch_id", F.col("begin").alias("ts")), ["batch_id", "ts"], "left_anti").select(
        "batch_id", "ts")
    both = stream.exceptAll(batch).unionByName(batch.exceptAll(stream)).groupBy("batch_id").agg(F.count(F.lit(1)).alias("differ"))
    return n.join(both, "batch_id", "left").select(
        "batch_id", "n", "last_us", F.coalesce("differ", F.lit(0)).cast("long").alias("differ"))
