"""Queries that store, load, export or stream the benchmark tables and read the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brewlens import bindings as B
from brewlens.operators import alignment, golden
from brewlens.operators.catalog import BatchFilter
from brewlens.schemas import TELEMETRY
from brewlens.session import ensure_checkpoint_dir
from brewlens.sources import export, ingest, landed, workbook
from brewlens.streaming import online
from brewlens.workload.runs import _MAPPING, _aligned, _points, _register, r6, us
from brewlens.workspace import Workspace


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/round-trip-{uuid.uuid4().hex}"


def _workspace(spark: SparkSession) -> Workspace:
    return Workspace(spark, _folder(spark), buckets=16)


# --- stored tables ----------------------------------------------------------------------------------------------


def _with_telemetry(spark, sf) -> tuple[Workspace, DataFrame]:
    """Telemetry appended in two parts, values above 100 replaced by NaN; and the rejected rows of the first."""
    ws = _workspace(spark)
    rows = B.telemetry(spark, sf).withColumn("value", F.when(F.col("value") > 100, float("nan")).otherwise(F.col("value")))
    bought = F.col("variable") == B.PRODUCT
    rejected = ws.append_telemetry(rows.where(bought))
    ws.append_telemetry(rows.where(~bought))
    return ws, rejected


@_register
def stored_telemetry(spark, sf):
    ws, _ = _with_telemetry(spark, sf)
    return ws.telemetry().select("batch_id", us("ts").alias("ts_us"), "variable", "value", "unit")


@_register
def stored_rejects(spark, sf):
    _, rejected = _with_telemetry(spark, sf)
    return rejected.groupBy("batch_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@_register
def stored_loads(spark, sf):
    """Purchases appended outside loads, all the rest by two loads: one of even batches that ran twice at a time, and one of
    odd batches whose first attempt broke off."""
    ws = _workspace(spark)
    rows = B.telemetry(spark, sf)
    bought, even = F.col("variable") == B.PRODUCT, F.col("batch_id").cast("long") % 2 == 0
    ws.append_telemetry(rows.where(bought))
    for part, attempt in ((even, "first"), (even, "second"), (~even, "broken"), (~even, "repeated")):
        ws.store.append("telemetry", rows.where(~bought & part), attempt)
        if attempt != "broken":
            ws.store.commit("even" if part is even else "odd", attempt)
    return ws.telemetry().select("batch_id", us("ts").alias("ts_us"), "variable", "value", "unit")


@_register
def stored_sensors(spark, sf):
    """Sensor records stored, some of them stored again with another deviation and one deleted, then applied."""
    ws = _workspace(spark)
    ws.append_telemetry(B.daily(spark, sf))
    records = B.sensor_records(spark, sf)
    ws.save_sensors(records)
    ws.save_sensors(records.where("model_type = 'pls'").withColumn("prediction_std", F.lit(7.0)))
    ws.delete_sensor("s1")
    both = ws.predict_stored()
    return both.groupBy("variable", "source", "uncertainty").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@_register
def stored_batch(spark, sf):
    """One batch from its bucket of the stored table."""
    ws, _ = _with_telemetry(spark, sf)
    return ws.telemetry("7").select("batch_id", us("ts").alias("ts_us"), "variable", "value", "unit")


@_register
def stored_assay(spark, sf):
    ws = _workspace(spark)
    ws.append_assay(B.assay(spark, sf))
    return ws.assay().select(
        "batch_id", us("ts").alias("ts_us"), "variable", "value", r6("uncertainty").alias("uncertainty"), "unit", "method")


@_register
def stored_phases(spark, sf):
    """Two runs of detection are stored, the later finds no decline and nothing in batch 9; batch 7 is deleted."""
    ws = _workspace(spark)
    found = B.phases(spark, sf)
    ws._save_phases(found, "pelt", None, "activity")
    ws._save_phases(found.where("phase_type <> 'decline' and batch_id <> '9'"), "pelt", None, "activity")
    ws.delete_phases("7")
    return ws.phases().select("batch_id", "phase_type", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"))


@_register
def stored_operations(spark, sf):
    ws = _workspace(spark)
    ws.add_operations(B.operations(spark, sf))
    return ws.operations().select(
        "operation_id", "batch_id", "name", "operation_type", F.array_join("parent_ids", ",").alias("parents"))


@_register
def stored_catalog(spark, sf):
    """Batches are added, the planned ones started, and batch 7 removed."""
    ws = _workspace(spark)
    ws.add_batches(B.batches(spark, sf))
    ws.update_batches(ws.search(BatchFilter(lifecycle="planned")).withColumn("lifecycle", F.lit("running")))
    ws.delete_batch("7")
    return ws.batches().select("batch_id", "name", "lifecycle", "meta_strain")


@_register
def cascading_delete(spark, sf):
    """Deleting batch 7 hides its telemetry too."""
    ws, _ = _with_telemetry(spark, sf)
    ws.add_batches(B.batches(spark, sf))
    ws.delete_batch("7", cascade=True)
    return ws.telemetry().groupBy("batch_id", "variable").agg(F.count(F.lit(1)).alias("n"))


@_register
def sql_text(spark, sf):
    """Spark SQL with a parameter over the registered views of stored tables."""
    ws, _ = _with_telemetry(spark, sf)
    ws.add_batches(B.batches(spark, sf))
    return ws.sql(
        "SELECT b.name, b.strain, t.variable, count(*) AS n, round(sum(t.value), 6) AS total"
        " FROM batches b JOIN telemetry t USING (batch_id) WHERE b.lifecycle <> ? GROUP BY ALL", ["planned"])


@_register
def golden_source(spark, sf):
    """A stored profile as the source of a query."""
    ws = _workspace(spark)
    ws.store.append("golden_profiles", golden.profile_of(alignment.resample(_aligned(spark, sf, ["click", "view"]), 720)))
    found = ws.query().golden_profile("golden").select("variable", "elapsed_us", "n_batches", "mean", "std").to_df()
    return found.select("variable", "elapsed_us", "n_batches", r6("mean").alias("mean"), r6("std").alias("std"))


# --- exports ----------------------------------------------------------------------------------------------------


def _both(spark, sf) -> tuple[Workspace, DataFrame]:
    """Stored sensors and assays; and the empty form of an exported row."""
    ws = _workspace(spark)
    ws.append_telemetry(B.telemetry(spark, sf).where(F.col("variable") != B.PRODUCT))
    ws.append_assay(B.assay(spark, sf))
    return ws, export.aligned_rows(ws.telemetry(), ws.assay())


def _exported(rows: DataFrame) -> DataFrame:
    return rows.select(
        "batch_id", us("ts").alias("ts_us"), "variable", "value", "unit", r6("uncertainty").alias("uncertainty"), "method")


@_register
def export_csv(spark, sf):
    (ws, rows), out = _both(spark, sf), _folder(spark)
    ws.export_many(None, out, "csv")
    return _exported(spark.read.schema(rows.schema).option("header", True).csv(out))


@_register
def export_parquet(spark, sf):
    (ws, rows), out = _both(spark, sf), _folder(spark)
    ws.export_many(None, out, "parquet")
    return _exported(spark.read.schema(rows.schema).parquet(out))


@_register
def export_arrow(spark, sf):
    (_, rows), out = _both(spark, sf), _folder(spark)
    export.export(rows, out, "arrow")
    return _exported(export.read_arrow(spark, out, rows.schema))


# --- audit --------------------------------------------------------------------------------------------------------


@_register
def stored_chain(spark, sf):
    """Entries appended behind a stored chain twice, by its heads."""
    ws, rows = _workspace(spark), B.audit_input(spark, sf)
    for low, high in ((0, 2), (2, 5), (5, 1 << 40)):
        part = rows.where(F.col("seq").between(low, high - 1))
        ws.append_audit(part.withColumn("seq", F.col("seq") - low))  # an append numbers on from the head
    return ws.audit_trail().select("tenant_id", "seq", "previous_entry_hash", "record_hash")


@_register
def stored_heads(spark, sf):
    ws, rows = _workspace(spark), B.audit_input(spark, sf)
    ws.append_audit(rows.where("seq < 3"))
    ws.append_audit(rows.where("seq >= 3").withColumn("seq", F.col("seq") - 3))
    return ws.audit_heads()


# --- loads ------------------------------------------------------------------------------------------------------


def _loaded(spark, sf) -> ingest.Load:
    """Text files, one per user: a header, a row of units, and readings whose column depends on the kind of event."""
    out = _folder(spark)
    e = B.events(spark, sf)
    cell = F.format_string("%.2f", "value")
    kinds = [F.coalesce(F.when(F.col("event_type") == k, cell), F.lit("")) for k in ("click", "error", "view")]
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    data = e.select("user_id", F.lit(2).alias("rank"), "ts", "event_id", F.concat_ws(";", stamp, *kinds).alias("value"))
    users = e.select("user_id").distinct()
    none = [F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("event_id")]
    for rank, text in enumerate(("timestamp;glucose;temperature;volume", ";mg/L;K;mL")):
        data = data.unionByName(users.select("user_id", F.lit(rank).alias("rank"), *none, F.lit(text).alias("value")))
    lines = data.repartition("user_id").sortWithinPartitions("user_id", "rank", "ts", "event_id")
    lines.select("user_id", "value").write.partitionBy("user_id").text(out)
    return ingest.load_delimited(spark, out)


def _user(source: str = "source"):
    return F.regexp_extract(source, "/user_id=([^/]+)/", 1).alias("user_id")


@_register
def text_load(spark, sf):
    return _loaded(spark, sf).records.select(
        _user(), us("ts").alias("ts_us"), "variable", r6("value").alias("value"), "unit")


@_register
def load_summary(spark, sf):
    return _loaded(spark, sf).summary().select(
        _user(), "rows_imported", "time_points", "columns_mapped", "columns_converted")


@_register
def original_rows(spark, sf):
    """Raw texts kept by a load."""
    return _loaded(spark, sf).original.groupBy(_user()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("fields")[1] != "").alias("n_glucose"),
        F.max(F.array_join("headers", ",")).alias("headers"))


@_register
def quoted_load(spark, sf):
    """Line items as files whose notes hold line breaks, separators and quotes; files of open items are UTF-16, and one
    more file has no time column."""
    out = _folder(spark)
    items = B.table(spark, sf, "lineitem")
    kind = F.concat("l_returnflag", "l_linestatus")
    note = F.concat(F.lit('"order '), "l_orderkey", F.lit('\n\nsaid ""ok"", '), "l_linenumber", F.lit('\n"'))
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    data = items.select(
        kind.alias("kind"), F.lit(1).alias("rank"), F.concat_ws(",", stamp, note, F.format_string("%.2f", "l_tax")).alias("line")
    )
    heads = items.select(kind.alias("kind")).distinct().select("kind", F.lit(0).alias("rank"), F.lit("timestamp,note,pH").alias("line"))
    stray = items.limit(1).select(F.lit("stray").alias("kind"), F.lit(0).alias("rank"), F.lit("a,b\n1,2").alias("line"))
    # A line feed of UTF-16 is 0A 00: the writer ends a row with 0A, so the next one begins with 00, and the first with a mark.
    wide = F.concat(F.when(F.col("rank") == 0, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit("00"))), F.encode("line", "utf-16le"))
    value = F.when(F.endswith("kind", F.lit("O")), wide.cast("string")).otherwise(F.col("line"))
    lines = data.unionByName(heads).unionByName(stray).repartition("kind").sortWithinPartitions("kind", "rank")
    lines.select("kind", value.alias("value")).write.partitionBy("kind").text(out)
    load = ingest.load_delimited(spark, out)
    name = F.regexp_extract("source", "/kind=([^/]+)/", 1).alias("kind")
    return load.records.groupBy(name, us("ts").alias("ts_us"), "variable").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


def _sheets(spark, sf) -> DataFrame:
    """Customers as sheets of a workbook per nation, and a sheet that describes it."""
    c = B.table(spark, sf, "customer")
    segment = F.col("c_mktsegment")
    headers = F.when(segment == "BUILDING", F.array(F.lit("Time"), F.lit("pH"))).when(
        segment == "MACHINERY", F.array(F.lit(" timestamp"), F.lit("Analyte"), F.lit("METHOD"))
    ).otherwise(F.array(F.lit("a"), F.lit("b")))
    sheets = c.select(
        F.col("c_nationkey").cast("string").alias("file"), F.concat_ws(" ", segment, "c_name").alias("sheet"),
        (F.col("c_custkey") + 1).cast("int").alias("sheet_no"), F.lit(0).alias("rn"), headers.alias("fields"))
    n = B.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("file"), F.lit("Run_Info ").alias("sheet"), F.lit(0).alias("sheet_no"),
        F.posexplode(F.array(
            F.array(F.lit(" Strain"), F.col("n_name")), F.array(F.lit("region"), F.col("n_regionkey").cast("string")),
            F.array(F.lit("region "), F.lit("again")), F.array(F.lit(""), F.lit("no key")),
        )).alias("rn", "fields"))
    return sheets.unionByName(n)


@_register
def sheet_types(spark, sf):
    return workbook.sheet_headers(_sheets(spark, sf)).select("file", "sheet", "type", "batch_per_sheet")


@_register
def run_per_sheet(spark, sf):
    """Workbooks of customers of one segment: those with equal headers on all of two or more sheets hold a run each."""
    rows = _sheets(spark, sf).where("sheet_no > 0").withColumn(
        "file", F.concat_ws(" ", "file", F.substring_index("sheet", " ", 1)))
    return workbook.sheet_headers(rows).select("file", "sheet", "batch_per_sheet")


@_register
def metadata_sheets(spark, sf):
    rows = _sheets(spark, sf)
    return workbook.metadata_maps(rows, workbook.sheet_headers(rows)).select("file", F.explode("metadata").alias("key", "value"))


@_register
def external_ids(spark, sf):
    """First id and first kind of event of each user, under the names of a mapping."""
    mapping = landed.SourceMapping("ts", (), {"event_type": "first_event"}, "session")
    rows = B.events(spark, sf).withColumn("session", F.when(F.col("event_type") == "view", F.col("event_id")))
    found = landed.external_ids(rows, mapping, F.col("user_id").cast("string"), "event_id")
    return found.select("batch_id", F.explode("external_ids").alias("key", "value"))


# --- streams ----------------------------------------------------------------------------------------------------


@_register
def stream_ingest(spark, sf):
    """A landing folder of wide rows, appended as mapped and unit-normalised telemetry by a stream that ends."""
    base = _folder(spark)
    wide = landed.pivot_fields(_points(spark, sf), ["click", "error", "view"], ["reactor_id"])
    wide.write.parquet(f"{base}/landing")
    landing = spark.readStream.schema(wide.schema).parquet(f"{base}/landing")
    online.ingest_stream(landing, _MAPPING, "reactor_id", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(TELEMETRY).parquet(f"{base}/out").select(
        "batch_id", us("ts").alias("ts_us"), "variable", r6("value").alias("value"), "unit")
