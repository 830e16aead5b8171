"""One entry point over stored tables: catalog, loads, retrieval, analytics, export and queries."""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brewlens.functions.scalars import stable_id
from brewlens.operators import alignment, audit, catalog, compliance, golden, lineage, metrics, phases, query, sensors
from brewlens.operators import timeseries as ts
from brewlens.schemas import BATCHES
from brewlens.session import cut_lineage, ship_package
from brewlens.sources import export as out
from brewlens.sources import ingest
from brewlens.sources.tables import TableStore


def _version() -> int:
    return time.time_ns() // 1_000


class Workspace:
    """Tables below ``root``; every method handles one or many batches with the same plan."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256) -> None:
        ship_package(spark)
        self.spark, self.store = spark, TableStore(spark, root, buckets)

    # --- catalog ---------------------------------------------------------------------------------------------

    def batches(self) -> DataFrame:
        return catalog.current_batches(self.store.read("batches"))

    def get_batch(self, batch_id: str) -> DataFrame:
        log = self.store.read("batches").where(F.col("batch_id") == F.lit(batch_id))
        return catalog.current_batches(log)

    def create_batch(self, name: str, *, lifecycle: str = "inoculated", batch_id: str | None = None, **details) -> str:
        """Add one batch; ``details`` are catalog columns without their ``meta_``/``ts_`` prefix."""
        now = datetime.now(UTC)
        columns = {f.name for f in BATCHES.fields}
        row: dict[str, object] = {
            "name": name, "lifecycle": lifecycle, "tags": [], "meta_extra": {}, "created_at": now, "updated_at": now,
        }
        for key, value in details.items():
            target = next((c for c in (key, f"meta_{key}", f"ts_{key}") if c in columns), None)
            if target is None:
                raise ValueError(f"unknown batch attribute: {key}")
            row[target] = value
        if batch_id is None:
            token = f"{name}|{now.isoformat()}|{time.monotonic_ns()}"
            batch_id = self.spark.range(1).select(stable_id(F.lit(token)).alias("id")).first()["id"]
        row["batch_id"] = batch_id
        self.add_batches(self.spark.createDataFrame([tuple(row.get(f.name) for f in BATCHES.fields)], BATCHES))
        return batch_id

    def add_batches(self, rows: DataFrame) -> None:
        good, rejected = catalog.validate_batches(rows)
        bad = rejected.select("reason").first()
        if bad is not None:
            raise ValueError(f"invalid batch: {bad['reason']}")
        clash = catalog.duplicate_ids(self.batches(), good).first()
        if clash is not None:
            raise ValueError(f"batch exists already: {clash['batch_id']}")
        self.store.append("batches", catalog.log_rows(good, _version()))

    def update_batches(self, rows: DataFrame) -> None:
        absent = catalog.missing_ids(self.batches(), rows).first()
        if absent is not None:
            raise ValueError(f"no such batch: {absent['batch_id']}")
        good, rejected = catalog.validate_batches(rows.withColumn("updated_at", F.current_timestamp()))
        bad = rejected.select("reason").first()
        if bad is not None:
            raise ValueError(f"invalid batch: {bad['reason']}")
        self.store.append("batches", catalog.log_rows(good, _version()))

    def delete_batch(self, batch_id: str, cascade: bool = False) -> None:
        """Remove a batch from the catalog.

        With ``cascade`` its telemetry, assays, phases and operations are hidden too: reads leave out the
        batches whose newest catalog version is a cascading deletion.
        """
        row = self.get_batch(batch_id)
        if row.isEmpty():
            raise ValueError(f"no such batch: {batch_id}")
        self.store.append("batches", catalog.log_rows(row, _version(), deleted=True, cascade=cascade))

    def search(self, criteria: catalog.BatchFilter) -> DataFrame:
        return catalog.search_batches(self.batches(), criteria)

    # --- measurements -------------------------------------------------------------------------------------------

    def _measurements(self, table: str, batch_ids: Sequence[str] | str | None) -> DataFrame:
        if isinstance(batch_ids, str):
            rows = self.store.read_batch(table, batch_ids)
        else:
            rows = self.store.read(table)
            if batch_ids is not None:
                rows = rows.where(F.col("batch_id").isin(list(batch_ids)))
        return catalog.remove(rows, catalog.cascaded_ids(self.store.read("batches")))

    def telemetry(self, batch_ids: Sequence[str] | str | None = None) -> DataFrame:
        return self._measurements("telemetry", batch_ids)

    def assay(self, batch_ids: Sequence[str] | str | None = None) -> DataFrame:
        return self._measurements("assay", batch_ids)

    def append_telemetry(self, rows: DataFrame) -> DataFrame:
        """Append valid rows; returns the rejected ones with a reason."""
        good, rejected = catalog.validate_telemetry(rows)
        self.store.append("telemetry", good)
        return rejected

    def append_assay(self, rows: DataFrame) -> DataFrame:
        good, rejected = catalog.validate_assay(rows)
        self.store.append("assay", good)
        return rejected

    def unified_view(self, batch_ids: Sequence[str] | str | None = None, per_sensor: bool = False) -> DataFrame:
        view = ts.unified_view_per_sensor if per_sensor else ts.unified_view
        return view(self.telemetry(batch_ids), self.assay(batch_ids))

    # --- loads -----------------------------------------------------------------------------------------------------

    def import_files(self, path: str, *, kind: str = "telemetry", load_id: str | None = None, **options) -> ingest.Load:
        """Load every delimited text file below ``path`` as one batch each; files with a problem are left out and reported
        in the result's ``problems``.

        The load becomes visible as a whole when its last table is written. One under the ``load_id`` of a load that is
        visible already stores nothing, so that a load that failed, or may have, can be repeated.
        """
        load = ingest.load_delimited(self.spark, path, **options)
        if not self._is_loaded(load_id):
            attempt = uuid.uuid4().hex
            self._store_load(load, kind, attempt)
            self.store.commit(load_id or attempt, attempt)
        return load

    def import_workbooks(self, path: str, *, load_id: str | None = None, **options) -> tuple[ingest.Load, ingest.Load]:
        """Telemetry and assays of all workbooks below ``path``, visible together; ``load_id`` as for files."""
        telemetry, assay, metadata = ingest.load_workbooks(self.spark, path, **options)
        if not self._is_loaded(load_id):
            attempt = uuid.uuid4().hex
            batches = telemetry.loadable()[0].unionByName(assay.loadable()[0]).select("batch_id", "name").distinct()
            self._add_loaded(ingest.apply_metadata(self._catalog_rows(batches), metadata), attempt)
            self._store_load(telemetry, "telemetry", attempt, register=False)
            self._store_load(assay, "assay", attempt, register=False)
            self.store.commit(load_id or attempt, attempt)
        return telemetry, assay

    def loads(self) -> DataFrame:
        """(load_id, attempt, loaded_at) of the loads that are visible."""
        return self.store.read("loads")

    def _is_loaded(self, load_id: str | None) -> bool:
        return load_id is not None and not self.loads().where(F.col("load_id") == F.lit(load_id)).isEmpty()

    def _catalog_rows(self, batches: DataFrame) -> DataFrame:
        now = F.current_timestamp()
        fixed = {"batch_id", "name"}
        defaults = {
            "lifecycle": F.lit("planned"), "tags": F.array().cast("array<string>"),
            "meta_extra": F.create_map().cast("map<string,string>"), "created_at": now, "updated_at": now,
        }
        return batches.select("batch_id", "name", *[
            defaults.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in BATCHES.fields if f.name not in fixed
        ])

    def _add_loaded(self, rows: DataFrame, attempt: str) -> None:
        self.store.append("batches", catalog.log_rows(catalog.remove(rows, self.batches()), _version()), attempt)

    def _store_load(self, load: ingest.Load, kind: str, attempt: str, register: bool = True) -> None:
        """Store what can be loaded; an error only if nothing can. ``load.problems`` has the rest."""
        batches, original = load.loadable()
        if batches.isEmpty():
            problem = load.problems.first()
            if problem is not None:
                raise ValueError(f"{problem['source']}: {problem['problem']}")
        if register:
            self._add_loaded(self._catalog_rows(batches.select("batch_id", "name")), attempt)
        if kind == "assay":
            self.store.append("assay", load.records.withColumns({"uncertainty": F.lit(0.0), "method": F.lit(None)}), attempt)
        else:
            self.store.append("telemetry", load.records, attempt)
        self.store.append("original", original, attempt)

    # --- analytics ---------------------------------------------------------------------------------------------------

    def phases(self, batch_ids: Sequence[str] | str | None = None) -> DataFrame:
        """Stored phases: the newest run per (batch, signal, method)."""
        rows = self._measurements("phases", batch_ids)
        newest = catalog.latest_by(rows, ["batch_id", "signal_variable", "method"], "_version")
        return newest.where(~F.col("_deleted")).drop("_version", "_deleted")

    def delete_phases(self, batch_id: str) -> None:
        gone = self.phases(batch_id).withColumns({"_version": F.lit(_version()), "_deleted": F.lit(True)})
        self.store.append("phases", gone)

    def detect_phases(
        self, batch_ids: Sequence[str] | str | None = None, signal: str = "OD600", min_size: int = 10, **options
    ) -> DataFrame:
        config = phases.DetectionConfig(signal=signal, min_size=min_size, **options)
        return self._save_phases(phases.detect_phases(self.telemetry(batch_ids), config), "pelt", batch_ids, signal)

    def detect_phases_online(
        self, batch_ids: Sequence[str] | str | None = None, signal: str = "OD600", hazard: float = 1 / 250,
        threshold: float = 0.5, **options,
    ) -> DataFrame:
        config = phases.OnlineConfig(signal=signal, hazard=hazard, threshold=threshold, **options)
        return self._save_phases(phases.detect_phases(self.telemetry(batch_ids), config), "bocpd", batch_ids, signal)

    def _save_phases(
        self, found: DataFrame, method: str, batch_ids: Sequence[str] | str | None, signal: str
    ) -> DataFrame:
        """Store a run of detection; the earlier phases of batches in which it finds none are deleted."""
        version = _version()
        self.store.append("phases", found.withColumns({
            "method": F.lit(method), "_version": F.lit(version), "_deleted": F.lit(False),
        }))
        stored = self.store.read("phases").where((F.col("_version") == version) & (F.col("method") == method))
        earlier = self.phases(batch_ids).where((F.col("method") == method) & (F.col("signal_variable") == signal))
        gone = earlier.join(stored.select("batch_id").distinct(), "batch_id", "left_anti")
        self.store.append("phases", gone.withColumns({"_version": F.lit(version), "_deleted": F.lit(True)}))
        return stored.where(~F.col("_deleted")).drop("method", "_version", "_deleted")

    def _signal_phases(self, batch_ids: Sequence[str] | str | None, signal: str) -> DataFrame:
        """Phases found now, once for one analysis; a checkpoint holds them, the phase table does not."""
        return cut_lineage(phases.detect_phases(self.telemetry(batch_ids), phases.DetectionConfig(signal=signal)))

    def compute_metrics(
        self, batch_ids: Sequence[str] | str | None = None, signal: str = "OD600", product: str | None = None,
        substrate: str | None = None, save: bool = False,
    ) -> DataFrame:
        found = metrics.batch_metrics(
            self.telemetry(batch_ids), self._signal_phases(batch_ids, signal), signal, product, substrate
        )
        if save:
            self.store.append("metrics", found)
        return found

    def align(
        self, batch_ids: Sequence[str], signal: str = "OD600", variables: Sequence[str] | None = None,
        anchor_phase: str = "exponential", resolution_minutes: float | None = None,
    ) -> DataFrame:
        """Long aligned form of the named batches; raises when a batch lacks the anchor phase."""
        telemetry = self.telemetry(batch_ids)
        bands = self._signal_phases(batch_ids, signal)
        lost = alignment.unanchored(telemetry, bands, anchor_phase).first()
        if lost is not None:
            raise ValueError(f"batch {lost['batch_id']} has no {anchor_phase} phase")
        aligned = alignment.align(telemetry, bands, anchor_phase, variables or [signal])
        return aligned if resolution_minutes is None else alignment.resample(aligned, resolution_minutes)

    def create_golden_profile(
        self, batch_ids: Sequence[str], variables: Sequence[str], signal: str | None = None,
        resolution_minutes: float | None = None, profile_id: str = "golden",
    ) -> DataFrame:
        aligned = self.align(batch_ids, signal or variables[0], variables, resolution_minutes=resolution_minutes)
        lost = golden.missing_series(aligned, batch_ids, variables).first()
        if lost is not None:
            raise ValueError(f"batch {lost['batch_id']} has no values of {lost['variable']}")
        profile = golden.golden_profile(aligned, batch_ids, variables, profile_id)
        self.store.append("golden_profiles", profile)
        return self.golden_profile(profile_id)

    def golden_profile(self, profile_id: str) -> DataFrame:
        return self.store.read("golden_profiles").where(F.col("profile_id") == F.lit(profile_id))

    def score_batches(
        self, profile: DataFrame, variables: Sequence[str], batch_ids: Sequence[str] | str | None = None,
        max_distance: float = 2.0,
    ) -> DataFrame:
        named = profile.first()
        return golden.score_batches(
            self.telemetry(batch_ids), profile, variables, max_distance=max_distance,
            profile_id=named["profile_id"] if named else "golden",
        )

    def overlay(
        self, batch_ids: Sequence[str], variables: Sequence[str] = ("OD600",), show_phases: bool = True
    ) -> tuple[DataFrame, DataFrame | None]:
        """(aligned series, phase bands of the first batch in hours) for one or more runs."""
        if not batch_ids:
            raise ValueError("overlay needs a batch")
        series = self.align(batch_ids, variables[0], variables)
        if not show_phases:
            return series, None
        bands = self._signal_phases(batch_ids[0], variables[0])
        return series, phases.phase_bands(bands, alignment.anchors(bands))

    def inspect(self, batch_id: str, signal: str = "OD600") -> DataFrame:
        """Signal of one batch with the phase of each sample."""
        rows = ts.of_variables(self.telemetry(batch_id), [signal])
        return phases.in_phases(rows, self._signal_phases(batch_id, signal))

    def predict(self, sensor: sensors.Sensor | sensors.LinearSensor, batch_ids: Sequence[str] | str | None = None) -> DataFrame:
        """Telemetry together with the sensor's predictions."""
        telemetry = self.telemetry(batch_ids)
        inputs = (
            [sensor.input_variable] if isinstance(sensor, sensors.LinearSensor) else list(sensor.input_variables)
        )
        lost = ts.missing_variables(telemetry, inputs).first()
        if lost is not None:
            raise ValueError(f"batch {lost['batch_id']} lacks input variable {lost['variable']}")
        return sensors.with_predictions(telemetry, sensors.apply_sensor(sensor, telemetry))

    def sensor_records(self) -> DataFrame:
        """Stored sensor records: the newest version of each."""
        newest = catalog.latest_by(self.store.read("sensors"), ["sensor_id"], "_version")
        return newest.where(~F.col("_deleted")).drop("_version", "_deleted")

    def save_sensors(self, records: DataFrame, models: Mapping[str, sensors.Sensor] | None = None) -> DataFrame:
        """Store the records that can be applied in place of their earlier versions; returns the issues of the others."""
        good = sensors.usable_records(records, models)
        self.store.append("sensors", good.withColumns({"_version": F.lit(_version()), "_deleted": F.lit(False)}))
        return sensors.record_issues(records, models)

    def delete_sensor(self, sensor_id: str) -> None:
        gone = self.sensor_records().where(F.col("sensor_id") == F.lit(sensor_id))
        self.store.append("sensors", gone.withColumns({"_version": F.lit(_version()), "_deleted": F.lit(True)}))

    def predict_stored(
        self, batch_ids: Sequence[str] | str | None = None, models: Mapping[str, sensors.Sensor] | None = None
    ) -> DataFrame:
        """Telemetry together with the predictions of all stored sensors."""
        telemetry = self.telemetry(batch_ids)
        return sensors.with_predictions(telemetry, sensors.apply_records(self.sensor_records(), telemetry, models))

    # --- lineage and audit ----------------------------------------------------------------------------------------

    def add_operations(self, rows: DataFrame) -> None:
        self.store.append("operations", rows)

    def operations(self, batch_ids: Sequence[str] | str | None = None) -> DataFrame:
        return self._measurements("operations", batch_ids)

    def downstream(self, operation_id: str, batch_id: str) -> DataFrame:
        start = self.spark.createDataFrame([(operation_id,)], "operation_id string")
        return lineage.descendants(self.operations(batch_id), start)

    def upstream(self, operation_id: str, batch_id: str) -> DataFrame:
        start = self.spark.createDataFrame([(operation_id,)], "operation_id string")
        return lineage.ancestors(self.operations(batch_id), start)

    def _trail(self) -> DataFrame:
        """Entries of all appends whose heads are stored (and of tables from before there were heads)."""
        rows = self.store.read("audit")
        whole = self.store.read("audit_heads").select("_version").distinct()
        before = rows.where("_version IS NULL")
        return rows.join(whole, "_version", "left_semi").select(*rows.columns).unionByName(before).drop("_version")

    def audit_heads(self) -> DataFrame:
        """(tenant_id, last_seq, last_hash): where each tenant's chain ends; the trail is not read."""
        heads = catalog.latest_by(self.store.read("audit_heads"), ["tenant_id"], "_version").drop("_version")
        old = audit.last_hashes(self.store.read("audit").where("_version IS NULL"))  # files of versions are skipped
        return heads.unionByName(old.join(heads, "tenant_id", "left_anti"))

    def append_audit(self, rows: DataFrame, signer=None) -> None:
        """Append entries behind the stored heads. The new heads are written last and make the entries visible: an append
        that fails before leaves nothing, and can be repeated."""
        version = _version()
        linked = cut_lineage(audit.append_entries(rows, signer=signer, heads=self.audit_heads()))
        self.store.append("audit", linked.withColumn("_version", F.lit(version)))
        self.store.append("audit_heads", audit.last_hashes(linked).withColumn("_version", F.lit(version)))

    def audit_trail(self, tenant_id: str | None = None) -> DataFrame:
        rows = self._trail()
        return rows if tenant_id is None else rows.where(F.col("tenant_id") == F.lit(tenant_id))

    def compliance_report(self, regulation: str | None = None, verifier=None, public_key_pem: str | None = None) -> DataFrame:
        return compliance.report(
            self._trail(), self.store.read("users"), regulation, verifier, public_key_pem
        )

    # --- export and query -------------------------------------------------------------------------------------------

    def export(
        self, batch_id: str, path: str, fmt: str = "csv", form: str = "aligned", include_assay: bool = True,
        allowed_root: str | None = None,
    ) -> DataFrame | None:
        """Write one batch; original form falls back to aligned rows, with a warning, when no raw text was kept."""
        target = out.check_target(path, allowed_root)
        if form not in out.FORMS:
            raise ValueError(f"unsupported form '{form}'")
        if form == "original":
            written = out.export_original(self.store.read_batch("original", batch_id), target, fmt)
            if written:
                return None if written[0] is None else reduce(DataFrame.unionByName, written)
            warnings.warn(f"batch {batch_id} has no original rows, aligned rows are exported", stacklevel=2)
        assay = self.assay(batch_id) if include_assay else None
        return out.export(out.aligned_rows(self.telemetry(batch_id), assay), target, fmt)

    def export_many(self, batch_ids: Sequence[str] | None, path: str, fmt: str = "parquet", include_assay: bool = True) -> None:
        """Write many batches at once, one folder per batch."""
        assay = self.assay(batch_ids) if include_assay else None
        out.export(out.aligned_rows(self.telemetry(batch_ids), assay), path, fmt, ["batch_id"])

    def views(self, scores: DataFrame | None = None) -> query.Views:
        return query.Views(
            self.batches(), self.phases(), self.store.read("metrics"), scores, self.store.read("golden_profiles")
        )

    def query(self, scores: DataFrame | None = None) -> query.BatchQuery:
        return query.BatchQuery(self.views(scores))

    def sql(self, text: str, args: Sequence[object] | None = None) -> DataFrame:
        self.telemetry().createOrReplaceTempView("telemetry")
        self.assay().createOrReplaceTempView("assay")
        return query.sql(self.spark, self.views(), text, args)
