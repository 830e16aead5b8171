from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brewlens import Workspace
from brewlens.operators import catalog, sensors
from brewlens.sources import export
from brewlens.sources.tables import upload_problems
from tests.conftest import START, growth_curve, signal_rows
from tests.test_ingest import ABSOLUTE, ELAPSED, make_workbook


@pytest.fixture
def ws(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "store"), buckets=8)


def add_five(ws):
    day = lambda d: datetime(2026, 3, d)
    rows = [
        ("CHO-Run-001", "running", "CHO-K1", "CD-CHO", "Dr. Smith", ["mAb", "scale-up"], day(1)),
        ("CHO-Run-002", "harvested", "CHO-K1", "CD-CHO", "Dr. Jones", ["mAb"], day(5)),
        ("CHO-Run-003", "running", "CHO-K1", "DMEM", "Dr. Smith", [], day(10)),
        ("HEK-Run-001", "aborted", "HEK293", "DMEM", "Dr. Smith", ["transient"], day(12)),
        ("EColi_100%", "planned", "BL21", "LB", "Dr. Lee", ["microbial", "scale-up"], None),
    ]
    ids = {}
    for name, cycle, strain, media, who, tags, start in rows:
        ids[name] = ws.create_batch(name, lifecycle=cycle, strain=strain, media=media, operator=who, tags=tags,
                                    inoculation=start, scale_liters=5.0)
    return ids


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_catalog_search_and_changes(ws, spark):
    ids = add_five(ws)
    search = lambda **k: names(ws.search(catalog.BatchFilter(**k)))
    assert len(search(strain="CHO-K1")) == 3 and len(search(operator="Dr. Smith")) == 3
    assert search(inoculation_after="2026-03-01", inoculation_before="2026-03-12") == [
        "CHO-Run-001", "CHO-Run-002", "CHO-Run-003"]
    assert search(strain="CHO-K1", tags=["scale-up"]) == ["CHO-Run-001"]
    assert search(name_contains="cho-run") == ["CHO-Run-001", "CHO-Run-002", "CHO-Run-003"]
    assert search(name_contains="100%") == ["EColi_100%"] and search(name_contains="_1") == ["EColi_100%"]
    assert search(lifecycle="running", media="DMEM") == ["CHO-Run-003"]
    assert len(search()) == 5

    with pytest.raises(ValueError, match="exists"):
        ws.create_batch("again", batch_id=ids["CHO-Run-001"])
    with pytest.raises(ValueError, match="lifecycle"):
        ws.create_batch("x", lifecycle="sleeping")
    with pytest.raises(ValueError, match="unknown batch attribute"):
        ws.create_batch("x", colour="red")
    ws.update_batches(ws.get_batch(ids["CHO-Run-001"]).withColumn("lifecycle", F.lit("harvested")))
    row = ws.get_batch(ids["CHO-Run-001"]).first()
    assert row["lifecycle"] == "harvested" and row["updated_at"] > row["created_at"]
    with pytest.raises(ValueError, match="no such batch"):
        ws.update_batches(ws.get_batch(ids["CHO-Run-001"]).withColumn("batch_id", F.lit("nope")))
    ws.delete_batch(ids["CHO-Run-002"])
    assert len(search()) == 4
    with pytest.raises(ValueError, match="no such batch"):
        ws.delete_batch(ids["CHO-Run-002"])

    first, more = catalog.page(ws.batches(), [F.col("name")], limit=3)
    assert first.count() == 3 and more.first()["has_next"]
    last, more = catalog.page(ws.batches(), [F.col("name")], limit=3, offset=3)
    assert last.count() == 1 and not more.first()["has_next"]
    top = catalog.newest_first(ws.batches(), 2).collect()
    assert [r["name"] for r in top] == ["EColi_100%", "HEK-Run-001"]


def test_measurements_and_cascade(ws, telemetry, spark):
    a, b = ws.create_batch("a"), ws.create_batch("b")
    rows = telemetry(signal_rows(a, "pH", [7.0, 7.1, float("nan")], 60), signal_rows(b, "pH", [6.9], 60))
    rejected = ws.append_telemetry(rows)
    assert [r["reason"] for r in rejected.collect()] == ["value not finite"]
    assay = telemetry(signal_rows(a, "glucose", [20.0, 18.0], 90)).withColumns(
        {"uncertainty": F.lit(0.2), "method": F.lit("HPLC")})
    assert ws.append_assay(assay.unionByName(assay.withColumn("uncertainty", F.lit(-1.0)))).count() == 2
    assert ws.telemetry(a).count() == 2 and ws.telemetry([a, b]).count() == 3 and ws.assay(a).count() == 2
    assert ws.telemetry("missing").isEmpty() and ws.telemetry().columns == ["batch_id", "ts", "variable", "value", "unit"]
    plan = ws.telemetry(a)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    joined = ws.unified_view(a).orderBy("assay_ts").collect()
    assert [r["sensor_value"] for r in joined] == [7.0, 7.1] and joined[0]["assay_method"] == "HPLC"
    assert ws.unified_view(a, per_sensor=True).count() == 2
    ws.append_telemetry(telemetry(signal_rows(a, "pH", [7.0], 60)))
    assert ws.telemetry(a).count() == 3
    ws.delete_batch(a, cascade=True)
    assert ws.telemetry(a).isEmpty() and ws.assay(a).isEmpty() and ws.telemetry().count() == 1
    ws.delete_batch(b)
    assert ws.telemetry(b).count() == 1


def test_load_detect_align_score(ws, telemetry, tmp_path):
    ids = [ws.create_batch(f"run{i}") for i in range(3)]
    parts = [signal_rows(b, "OD600", growth_curve(i, 40 + 10 * i)) for i, b in enumerate(ids)]
    parts += [signal_rows(b, "pH", 7 + 0.01 * np.arange(230)) for b in ids]
    ws.append_telemetry(telemetry(*parts))
    found = ws.detect_phases(ids, penalty=5.0)
    again = ws.detect_phases(ids, penalty=5.0)
    assert ws.phases().count() == found.count() == again.count()
    rows = ws.store.read("phases").count()
    assert ws.inspect(ids[0]).count() > 0 and ws.store.read("phases").count() == rows  # reading stores nothing
    ws._save_phases(found.limit(0), "pelt", ids, "OD600")
    assert ws.phases(ids).isEmpty()  # a run that finds nothing replaces the one before
    ws.detect_phases(ids, penalty=5.0)
    aligned = ws.align(ids, resolution_minutes=5, variables=["OD600", "pH"])
    assert aligned.where("elapsed_hours < 0").count() > 0 and aligned.select("batch_id").distinct().count() == 3
    with pytest.raises(ValueError, match="no decline2 phase"):
        ws.align(ids, anchor_phase="decline2")
    profile = ws.create_golden_profile(ids[:2], ["OD600", "pH"], "OD600", resolution_minutes=5)
    assert profile.select("variable").distinct().count() == 2
    with pytest.raises(ValueError, match="no values of zz"):
        ws.create_golden_profile(ids[:2], ["OD600", "zz"])
    scores = ws.score_batches(profile, ["OD600"], ids)
    assert scores.where("error is null").count() == 3
    assert ws.compute_metrics(ids, save=True).where("mu is not null").count() >= 1
    assert ws.detect_phases_online(ids[0]).count() >= 1
    series, bands = ws.overlay(ids, ["OD600"])
    assert series.count() > 0 and bands.where("phase_type = 'exponential' and start_hours = 0").count() == 1
    with pytest.raises(ValueError):
        ws.overlay([])
    assert ws.inspect(ids[0]).select("phase_type").distinct().count() > 1
    both = ws.predict(sensors.LinearSensor("OD600", "dcw", 0.4, 0.0), ids[0])
    assert both.where("variable = 'dcw'").count() == 250
    with pytest.raises(ValueError, match="lacks input"):
        ws.predict(sensors.LinearSensor("none", "dcw", 0.4, 0.0), ids[0])
    query = ws.query(scores)
    from brewlens.operators import query as q

    rows = query.select("name", q.phase_duration("exponential").named("hours"), q.growth_rate().named("mu"),
                        q.golden_score().named("score")).where(q.field("name").like("run%")).to_df().collect()
    assert {r["name"] for r in rows} == {"run0", "run1", "run2"} and all(r["score"] is not None for r in rows)
    text = ws.sql("SELECT name, count(*) AS n FROM batches JOIN telemetry USING (batch_id) WHERE name = ? GROUP BY name", ["run0"])
    assert text.first()["n"] == 250 + 230
    ws.delete_phases(ids[0])
    assert ws.phases(ids[0]).isEmpty() and not ws.phases(ids[1]).isEmpty()


def test_imports_and_exports(ws, spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "run.csv").write_text(ABSOLUTE)
    load = ws.import_files(str(inbox))
    batch = load.batches.first()["batch_id"]
    assert ws.telemetry(batch).count() == 25 and names(ws.batches()) == ["run"]
    elapsed = tmp_path / "elapsed"
    elapsed.mkdir()
    (elapsed / "e.csv").write_text(ELAPSED)
    with pytest.raises(ValueError, match="inoculation"):
        ws.import_files(str(elapsed))
    ws.import_files(str(elapsed), inoculation="2026-04-20 08:00:00", kind="assay")
    assert ws.assay().count() == 20
    books = tmp_path / "books"
    books.mkdir()
    (books / "m.xlsx").write_bytes(make_workbook({
        "Metadata": [["strain", "CHO"], ["pump", "P7"]], "S": [["time", "pH"], [datetime(2026, 1, 1), 7.0]]}))
    ws.import_workbooks(str(books))
    row = ws.search(catalog.BatchFilter(strain="CHO")).first()
    assert row["name"] == "m" and row["meta_extra"] == {"pump": "P7"}

    root = str(tmp_path / "out")
    ws.export(batch, f"{root}/csv", "csv", include_assay=False, allowed_root=root)
    back = spark.read.schema(ws.telemetry().schema).option("header", True).csv(f"{root}/csv")
    assert back.exceptAll(ws.telemetry(batch)).isEmpty() and back.count() == 25
    ws.export(batch, f"{root}/pq", "parquet", include_assay=False)
    assert spark.read.parquet(f"{root}/pq").exceptAll(ws.telemetry(batch)).isEmpty()
    files = ws.export(batch, f"{root}/arrow", "arrow").collect()
    tables = [pa.ipc.open_file(r["file"].removeprefix("file://")).read_all() for r in files]
    assert sum(t.num_rows for t in tables) == 25 == sum(r["n_rows"] for r in files)
    both = export.read_arrow(spark, f"{root}/arrow", ws.telemetry().schema)
    assert both.exceptAll(ws.telemetry(batch)).isEmpty() and both.count() == 25
    ws.export(batch, f"{root}/orig", "csv", form="original")
    raw = spark.read.option("header", True).csv(f"{root}/orig")
    assert raw.columns == ["timestamp", "pH", "DO_%", "temp_C", "OD600", "glucose_g_L"] and raw.count() == 5
    assert "20.0" in {r["glucose_g_L"] for r in raw.collect()}
    other = spark.createDataFrame([(batch, "b.csv", ["time", "pH"], ["0", "7.0"])], ws.store.read("original").schema)
    ws.store.append("original", other)
    ws.export(batch, f"{root}/orig2", "csv", form="original")
    found = [spark.read.option("header", True).csv(f"{root}/orig2/layout={i}") for i in (0, 1)]
    assert sorted((len(f.columns), f.count()) for f in found) == [(2, 1), (6, 5)]
    assayed = ws.assay().first()["batch_id"]
    ws.store.append("assay", ws.assay(assayed).withColumn("batch_id", F.lit("bare")))
    with pytest.warns(UserWarning, match="no original rows"):
        ws.export("bare", f"{root}/bare", "parquet", form="original")
    assert spark.read.parquet(f"{root}/bare").count() == 20  # assays are part of the fallback
    ws.export_many(None, f"{root}/all")
    assert spark.read.parquet(f"{root}/all").select("batch_id").distinct().count() == 4
    with pytest.raises(ValueError, match="no data"):
        ws.export("missing", f"{root}/none")
    with pytest.raises(ValueError, match="unsupported format"):
        ws.export(batch, f"{root}/x", "xml")
    for bad in (f"{root}/../x", "/etc/x"):
        with pytest.raises(ValueError):
            export.check_target(bad, root)


def test_lineage_and_audit_tables(ws, spark):
    ops = spark.createDataFrame(
        [("s", "b", "seed_train", "upstream", []), ("f", "b", "fermentation", "upstream", ["s"]),
         ("c", "b", "centrifugation", "downstream", ["f"]), ("x", "b", "sample", "analytical", ["s", "gone"])],
        "operation_id string, batch_id string, name string, operation_type string, parent_ids array<string>")
    ws.add_operations(ops.withColumns({"started_at": F.lit(None), "ended_at": F.lit(None), "parameters": F.lit(None)}))
    assert {(r["operation_id"], r["depth"]) for r in ws.downstream("s", "b").collect()} == {("f", 1), ("x", 1), ("c", 2)}
    assert {r["operation_id"] for r in ws.upstream("c", "b").collect()} == {"f", "s"}
    assert ws.upstream("s", "b").isEmpty()


def test_upload_checks(spark, telemetry, tmp_path):
    good = telemetry(signal_rows("a", "x", [1.0]))
    good.coalesce(1).write.parquet(str(tmp_path / "good"))
    assert upload_problems(spark, str(tmp_path / "good/*.parquet")).isEmpty()
    good.drop("unit").withColumn("value", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "bad"))
    problems = {r["problem"] for r in upload_problems(spark, str(tmp_path / "bad/*.parquet")).collect()}
    assert problems == {"column unit missing", "column value is not double"}
    good.limit(0).coalesce(1).write.parquet(str(tmp_path / "empty"))
    assert [r["problem"] for r in upload_problems(spark, str(tmp_path / "empty/*.parquet")).collect()] == ["empty or unreadable"]


def test_an_audit_append_is_visible_as_a_whole(ws, spark, monkeypatch):
    from brewlens.operators import audit

    def part(first, n):
        return spark.createDataFrame(
            [("t", i, f"e{first + i}", START, "u", "create", "batch", "b", "", f"h{first + i}", "") for i in range(n)],
            "tenant_id string, seq long, entry_id string, timestamp timestamp, user_id string, action string, entity_type string,"
            " entity_id string, old_value_hash string, new_value_hash string, reason string")

    ws.append_audit(part(0, 3))
    append = ws.store.append

    def broken(table, rows):
        if table == "audit_heads":
            raise RuntimeError("lost")
        append(table, rows)

    monkeypatch.setattr(ws.store, "append", broken)
    with pytest.raises(RuntimeError):
        ws.append_audit(part(3, 2))
    monkeypatch.undo()
    assert ws.audit_trail().count() == 3
    ws.append_audit(part(3, 2))
    trail = ws.audit_trail()
    assert sorted(r["seq"] for r in trail.collect()) == [0, 1, 2, 3, 4]
    assert audit.chain_verdict(trail).first()["intact"]
    head = ws.audit_heads().first()
    assert (head["last_seq"], head["last_hash"]) == (4, trail.where("seq = 4").first()["record_hash"])


def test_stored_sensors(ws, spark, telemetry):
    from brewlens.schemas import SENSORS

    ws.append_telemetry(telemetry(signal_rows("b", "x", [1.0, 2.0]), signal_rows("b", "y", [10.0, 20.0])))
    rows = [("sum", "s", ["x", "y"], "linear", [1.0, 2.0], None, None, 0.5, 0.1, {}),
            ("bad", "z", ["x"], "forest", [1.0], None, None, 0.0, None, {}),
            ("none", "z", [], "linear", [], None, None, 0.0, None, None),
            ("twice", "z", ["x"], "linear", [1.0], None, None, 0.0, None, None),
            ("twice", "z", ["x"], "linear", [2.0], None, None, 0.0, None, None),
            ("model", "m", ["x"], "custom", None, None, None, None, None, {"model": "gone"})]
    issues = ws.save_sensors(spark.createDataFrame(rows, SENSORS))
    assert {(r["sensor_id"], r["issue"]) for r in issues.collect()} == {
        ("bad", "unknown model type"), ("none", "no input variables"), ("twice", "several records"), ("model", "model not at hand")}
    got = ws.predict_stored().where("source is not null").orderBy("ts").collect()
    assert [r["value"] for r in got] == [21.5, 42.5] and {r["variable"] for r in got} == {"s"}
    ws.save_sensors(spark.createDataFrame([("sum", "s", ["x"], "pls", [4.0], [1.0], [2.0], 1.0, None, {})], SENSORS))
    assert sorted(r["value"] for r in ws.predict_stored().where("variable = 's'").collect()) == [1.0, 3.0]
    ws.delete_sensor("sum")
    assert ws.sensor_records().isEmpty() and ws.predict_stored().where("source is not null").isEmpty()


def test_bad_files_do_not_stop_the_others(ws, spark, tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    (folder / "good.csv").write_text(ABSOLUTE)
    (folder / "timeless.csv").write_text("a,b\n1,2\n3,4\n")
    (folder / "open.csv").write_text('timestamp,pH\n2026-01-01 00:00:00,"7\n')
    load = ws.import_files(str(folder))
    problems = {r["source"].split("/")[-1]: r["problem"] for r in load.problems.collect()}
    assert problems == {"timeless.csv": "no timestamp column", "open.csv": "a quote is not closed"}
    assert [r["name"] for r in ws.batches().collect()] == ["good"] and ws.telemetry().count() == 25
    (folder / "good.csv").unlink()
    with pytest.raises(ValueError):
        ws.import_files(str(folder))


def test_loads_are_visible_as_a_whole(ws, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "run.csv").write_text(ABSOLUTE)
    ids = add_five(ws)
    counts = lambda: [ws.store.read(t).count() for t in ("batches", "telemetry", "original", "loads")]
    append = ws.store.append

    def failing(table, rows, attempt=None):
        if table == "original":
            raise OSError("disk full")
        append(table, rows, attempt)

    monkeypatch.setattr(ws.store, "append", failing)
    with pytest.raises(OSError, match="disk full"):
        ws.import_files(str(folder), load_id="monday")
    monkeypatch.undo()
    assert counts() == [5, 0, 0, 0] and "run" not in names(ws.batches())
    batch = ws.import_files(str(folder), load_id="monday").batches.first()["batch_id"]
    assert counts()[:2] == [6, 25] and ws.telemetry(batch).count() == 25
    before = counts()
    ws.import_files(str(folder), load_id="monday")
    assert counts() == before and [r["load_id"] for r in ws.loads().collect()] == ["monday"]

    # Two attempts that ran at the same time: the rows of one are seen.
    append("telemetry", ws.telemetry(batch), "late")
    assert ws.telemetry(batch).count() == 25
    ws.store.commit("monday", "late")
    assert counts()[:2] == [6, 25] and ws.telemetry(batch).count() == 25
    with pytest.raises(ValueError, match="do not write"):
        append("users", ws.store.read("users"), "late")

    small = Workspace(ws.spark, str(tmp_path / "small"), buckets=8)
    for table in ("batches", "telemetry"):
        ws.store.compact(table, small.store.root)
    assert small.loads().isEmpty() and small.telemetry(batch).count() == 25
    assert sorted(names(small.batches())) == sorted([*ids, "run"])


def test_export_of_many_writes_a_file_a_batch(spark, tmp_path):
    """Rows of a batch from several appends lie in one file of its folder; those of another quarter in a second."""
    store = Workspace(spark, str(tmp_path / "ws"), buckets=2)
    rows = spark.range(400).select(
        (F.col("id") % 20).cast("string").alias("batch_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
        F.lit("x").alias("variable"), F.col("id").cast("double").alias("value"), F.lit(None).cast("string").alias("unit"))
    later = rows.where("batch_id = '3'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 100 DAYS"))
    for part in (rows.where("id < 200"), rows.where("id >= 200"), later):
        store.append_telemetry(part)
    for fmt in ("parquet", "csv"):
        out = tmp_path / fmt
        store.export_many(None, str(out), fmt, include_assay=False)
        files = {d.name: len(list(d.glob("part-*"))) for d in out.glob("batch_id=*")}
        assert files == {f"batch_id={b}": 2 if b == 3 else 1 for b in range(20)}
        reader = spark.read.option("header", True)
        back = reader.parquet(str(out)) if fmt == "parquet" else reader.csv(str(out))
        assert back.count() == 420 and back.agg(F.sum(F.col("value").cast("double"))).first()[0] == 79_800 + sum(range(3, 400, 20))
