import json

import pytest
from pyspark.sql import functions as F

from brewlens.sources import landed
from tests.conftest import START


def test_wide_extracts(spark):
    mapping = landed.SourceMapping.from_dict({
        "timestamp_field": "when",
        "variable_mappings": [{"source": "DO", "target": "dissolved_oxygen", "unit": "%"},
                              {"source": "T", "target": "temperature", "unit": "K"},
                              {"source": "X", "target": "x", "transform": "offset:-1"}, {"source": "gone", "target": "y"}],
        "metadata_mappings": {"reactor": "bioreactor_id"}, "external_id_field": "sample"})
    df = spark.createDataFrame([(START, 90.0, 310.15, 5.0, "R1", None), (START, float("nan"), None, 6.0, "R2", "S7")],
                               "_time timestamp, DO double, T double, X double, reactor string, sample string")
    assert landed.missing_sources(df, mapping) == ["gone"]
    out = landed.wide_to_telemetry(df, mapping, "b", normalise=True)
    got = {(r["variable"], round(r["value"], 6), r["unit"]) for r in out.collect()}
    assert got == {("dissolved_oxygen", 90.0, "%"), ("temperature", 37.0, "C"), ("x", 4.0, None), ("x", 5.0, None)}
    ids = landed.external_ids(df, mapping, F.lit("b"), "_time").first()["external_ids"]
    assert ids["sample"] == "S7" and ids["bioreactor_id"] in ("R1", "R2")
    with pytest.raises(ValueError, match="timestamp column"):
        landed.wide_to_telemetry(df.drop("_time"), mapping, "b")
    with pytest.raises(ValueError, match="no mapped source"):
        landed.wide_to_telemetry(df.select("_time"), mapping, "b")
    with pytest.raises(ValueError, match="transform"):
        landed.FieldMapping("a", "b", None, "log:2").apply(F.lit(1.0))


def test_point_lists(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps(x) for x in [
        {"point": "DO", "Items": [{"Timestamp": "2026-04-20T08:00:00Z", "Value": 90.5}, {"Timestamp": "2026-04-20T10:00:00+02:00", "Value": 91}]},
        {"point": "PH", "Items": [{"Timestamp": "2026-04-20T08:00:00Z", "Value": 7.0}]},
        {"point": "OTHER", "Items": [{"Timestamp": "2026-04-20T08:00:00Z", "Value": 1.0}]}]))
    points = spark.read.json(str(tmp_path))
    mapping = landed.SourceMapping.default("pi")
    got = landed.points_to_telemetry(points, mapping, "b").orderBy("variable", "value").collect()
    assert [(r["variable"], r["value"], r["unit"]) for r in got] == [
        ("dissolved_oxygen", 90.5, "%"), ("dissolved_oxygen", 91.0, "%"), ("ph", 7.0, None)]
    assert len({r["ts"] for r in got}) == 1
    assert {r["source"] for r in landed.missing_points(points, mapping).collect()} == {"TEMP", "AGIT", "OD600"}
    found = spark.createDataFrame([("DO", "ppm"), ("TEMP", "C")], "source string, unit string")
    assert [r["source"] for r in landed.unit_mismatches(found, mapping).collect()] == ["DO"]


def test_lab_results(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"data": [
        {"analysis_date": "2026-04-20 08:00:00", "titer": "1.5", "vcd": 2e6, "uncertainty": 0.1, "unit": "U", "testmethod": "ELISA"},
        {"analysis_date": "", "titer": "2"}, {"analysis_date": "soon", "titer": "2"},
        {"analysis_date": "2026-04-21", "titer": "n/a", "glucose": "4"}]}))
    rows = landed.explode_data(spark.read.json(str(tmp_path)))
    assay, skipped = landed.results_to_assay(rows, landed.SourceMapping.default("labvantage"), "b")
    got = {(r["variable"], r["value"], r["uncertainty"], r["unit"], r["method"]) for r in assay.collect()}
    assert got == {("titer", 1.5, 0.1, "g/L", "ELISA"), ("viable_cell_density", 2e6, 0.1, "cells/mL", "ELISA"), ("glucose", 4.0, 0.0, "g/L", "lims")}
    assert sorted(r["reason"] for r in skipped.collect()) == ["no timestamp", "timestamp not readable"]


def test_notebook_results(spark, tmp_path):
    def result(name, value, **more):
        return {"attributes": {"name": name, "value": value, "created_at": "2026-04-20T08:00:00Z", **more}}

    (tmp_path / "e.json").write_text("\n".join(json.dumps(x) for x in [
        result("titer", "1.5"), result("ph", "7.1", unit="-"), result("titer", "cloudy"), result("colour", "amber"),
        result("count", "12"), result("titer", "9", created_at="")]))
    assay, notes = landed.notebook_results(spark.read.json(str(tmp_path)), landed.SourceMapping.default("scinote"), "b")
    assert {(r["variable"], r["value"], r["unit"], r["method"]) for r in assay.collect()} == {
        ("titer", 1.5, "g/L", "eln"), ("ph", 7.1, "-", "eln")}
    assert notes.first()["observations"] == {"titer": "cloudy", "colour": "amber"}


def test_historian_rows(spark):
    df = spark.createDataFrame([(START, "m", "a", 1.0), (START, "m", "b", 2.0), (START, "n", "a", 3.0)],
                               "_time timestamp, _measurement string, _field string, _value double")
    chosen = landed.select_points(df, "m", ["a", "b"], "2026-04-20 00:00:00", "2026-04-21 00:00:00")
    assert [tuple(r)[1:] for r in landed.pivot_fields(chosen, ["a", "b"], []).collect()] == [(1.0, 2.0)]
    with pytest.raises(ValueError):
        landed.select_points(df, "")
