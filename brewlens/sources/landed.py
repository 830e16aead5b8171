"""Extracts of external systems that were landed as files: historian, process information, LIMS, ELN.

Network clients are not part of this library; a landed extract (CSV, JSON, Parquet) is read with the usual
Spark readers and turned into telemetry or assay rows here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brewlens import constants as K
from brewlens.functions import scalars as S


@dataclass(frozen=True)
class FieldMapping:
    source: str
    target: str
    unit: str | None = None
    transform: str | None = None  # "multiply:x" or "offset:x"

    def apply(self, value: Column) -> Column:
        if self.transform is None:
            return value
        kind, _, number = self.transform.partition(":")
        if kind == "multiply":
            return value * F.lit(float(number))
        if kind == "offset":
            return value + F.lit(float(number))
        raise ValueError(f"unknown transform: {self.transform}")


@dataclass(frozen=True)
class SourceMapping:
    timestamp_field: str
    variables: tuple[FieldMapping, ...]
    metadata: dict[str, str] = field(default_factory=dict)
    external_id_field: str | None = None

    @classmethod
    def default(cls, system: str) -> SourceMapping:
        d = K.DEFAULT_MAPPINGS[system]
        return cls(
            d["timestamp_field"], tuple(FieldMapping(*v) for v in d["variables"]), dict(d["metadata"]),
            d["external_id_field"],
        )

    @classmethod
    def from_dict(cls, d: dict) -> SourceMapping:
        """From the parsed form of a mapping file."""
        return cls(
            d["timestamp_field"],
            tuple(FieldMapping(v["source"], v["target"], v.get("unit"), v.get("transform"))
                  for v in d.get("variable_mappings", [])),
            dict(d.get("metadata_mappings", {})), d.get("external_id_field"),
        )


def missing_sources(df: DataFrame, mapping: SourceMapping) -> list[str]:
    """Mapped source fields that a wide extract does not have (schema only, no job)."""
    return [m.source for m in mapping.variables if m.source not in df.columns]


def missing_points(points: DataFrame, mapping: SourceMapping, point: str = "point") -> DataFrame:
    """(source, warning) for mapped points that never occur in a long extract."""
    wanted = points.sparkSession.createDataFrame([(m.source,) for m in mapping.variables], "source string")
    seen = points.select(F.col(point).alias("source")).distinct()
    return wanted.join(seen, "source", "left_anti").withColumn(
        "warning", F.concat(F.lit("Source field '"), F.col("source"), F.lit("' not found"))
    )


def unit_mismatches(found: DataFrame, mapping: SourceMapping) -> DataFrame:
    """(source, mapped_unit, found_unit) where a system's own unit differs from the mapping's."""
    wanted = found.sparkSession.createDataFrame(
        [(m.source, m.unit) for m in mapping.variables if m.unit], "source string, mapped_unit string"
    )
    return found.join(F.broadcast(wanted), "source").where(F.col("unit") != F.col("mapped_unit")).select(
        "source", "mapped_unit", F.col("unit").alias("found_unit")
    )


def _timestamp(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return S.parse_timestamp(F.col(name)) if kind == "string" else F.col(name).cast("timestamp")


def _number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return S.numeric(F.col(name)) if kind == "string" else S.finite(F.col(name).cast("double"))


def _unpivot(df: DataFrame, keep: Sequence[Column], mapping: SourceMapping, normalise: bool) -> DataFrame:
    """Mapped columns as (keep..., variable, value, unit); one row per present value, no shuffle."""
    present = [m for m in mapping.variables if m.source in df.columns]
    if not present:
        raise ValueError("no mapped source field is present")
    cells = []
    for m in present:
        value, unit = m.apply(_number(df, m.source)), F.lit(m.unit).cast("string")
        if normalise:
            canonical = S.canonical_unit(F.lit(m.target))
            converted = S.convert_unit(value, unit, canonical)
            unit = F.when(converted.isNotNull(), canonical).otherwise(unit)
            value = F.coalesce(converted, value)
        cells.append(F.struct(F.lit(m.target).alias("variable"), value.alias("value"), unit.alias("unit"),
                              F.lit(m.source).alias("source_field")))
    return df.select(*keep, F.explode(F.array(*cells)).alias("c")).select("*", "c.*").drop("c").where(
        "value is not null"
    )


# --- historian (wide or field/value rows) ---------------------------------------------------------------------


def select_points(
    df: DataFrame, measurement: str, fields: Sequence[str] | None = None,
    start: str | None = None, end: str | None = None, time: str = "_time",
) -> DataFrame:
    """Range, measurement and field selection on landed historian rows."""
    if not measurement:
        raise ValueError("measurement is required")
    out = df.where(F.col("_measurement") == measurement)
    if fields is not None:
        out = out.where(F.col("_field").isin(list(fields)))
    if start is not None:
        out = out.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col(time) < F.lit(end).cast("timestamp"))
    return out


def pivot_fields(df: DataFrame, fields: Sequence[str], keys: Sequence[str], time: str = "_time") -> DataFrame:
    """Field/value rows as one column per field; the smallest value stands for duplicates."""
    return df.groupBy(*keys, time).pivot("_field", list(fields)).agg(F.min("_value"))


def wide_to_telemetry(
    df: DataFrame, mapping: SourceMapping, batch_id: str | Column, normalise: bool = False
) -> DataFrame:
    """Telemetry rows of a wide extract; missing values give no row.

    The mapped time field is used, else ``_time``.
    """
    time = next((c for c in (mapping.timestamp_field, "_time") if c in df.columns), None)
    if time is None:
        raise ValueError(f"timestamp column '{mapping.timestamp_field}' not found; columns: {df.columns}")
    bid = F.lit(batch_id) if isinstance(batch_id, str) else batch_id
    rows = _unpivot(df, [bid.alias("batch_id"), _timestamp(df, time).alias("ts")], mapping, normalise)
    return rows.where("ts is not null").select("batch_id", "ts", "variable", "value", "unit")


def external_ids(df: DataFrame, mapping: SourceMapping, batch_id: Column, order: str) -> DataFrame:
    """First non-null external id and renamed metadata per batch, as a map."""
    names = {k: v for k, v in mapping.metadata.items() if k in df.columns}
    if mapping.external_id_field in df.columns:
        names.setdefault(mapping.external_id_field, mapping.external_id_field)
    picks = [
        F.min_by(F.col(k).cast("string"), F.when(F.col(k).isNotNull(), F.col(order))).alias(v) for k, v in names.items()
    ]
    first = df.groupBy(batch_id.alias("batch_id")).agg(*picks) if picks else df.select(batch_id.alias("batch_id")).distinct()
    pairs = F.array_compact(F.array(*[
        F.when(F.col(v).isNotNull(), F.struct(F.lit(v).alias("k"), F.col(v).alias("v"))) for v in names.values()
    ])) if names else None
    entries = F.map_from_entries(pairs) if names else F.create_map().cast("map<string,string>")
    return first.select("batch_id", entries.alias("external_ids"))


# --- process information system (one list of readings per point) -----------------------------------------------


def points_to_telemetry(df: DataFrame, mapping: SourceMapping, batch_id: str | Column) -> DataFrame:
    """Rows (point, Items[array of Timestamp, Value]) as telemetry of the mapped points."""
    bid = F.lit(batch_id) if isinstance(batch_id, str) else batch_id
    table = df.sparkSession.createDataFrame(
        [(m.source, m.target, m.unit, m.transform) for m in mapping.variables],
        "point string, variable string, unit string, transform string",
    )
    readings = df.select(bid.alias("batch_id"), "point", F.explode("Items").alias("i")).select(
        "batch_id", "point", S.parse_timestamp(F.col("i.Timestamp").cast("string")).alias("ts"),
        S.numeric(F.col("i.Value").cast("string")).alias("raw"),
    )
    joined = readings.join(F.broadcast(table), "point")  # one row per mapped point
    kind, number = F.substring_index("transform", ":", 1), F.substring_index("transform", ":", -1).try_cast("double")
    value = F.when(kind == "multiply", F.col("raw") * number).when(kind == "offset", F.col("raw") + number).otherwise(
        F.col("raw")
    )
    return joined.select("batch_id", "ts", "variable", value.alias("value"), "unit").where(
        "ts is not null and value is not null"
    )


# --- LIMS ---------------------------------------------------------------------------------------------------------


def results_to_assay(df: DataFrame, mapping: SourceMapping, batch_id: str | Column) -> tuple[DataFrame, DataFrame]:
    """(assay rows, skipped rows) of landed result rows, one column per result field.

    The unit is the mapping's, else the row's; method defaults to ``lims`` and uncertainty to 0.
    """
    bid = F.lit(batch_id) if isinstance(batch_id, str) else batch_id

    def optional(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None)

    ts = _timestamp(df, mapping.timestamp_field)
    keep = [
        bid.alias("batch_id"), ts.alias("ts"),
        F.coalesce(S.numeric(optional("uncertainty").cast("string")), F.lit(0.0)).alias("uncertainty"),
        F.coalesce(optional("unit").cast("string"), F.lit("")).alias("row_unit"),
        F.coalesce(optional("testmethod").cast("string"), F.lit("lims")).alias("method"),
    ]
    rows = _unpivot(df, keep, mapping, normalise=False).where("ts is not null")
    raw = F.col(mapping.timestamp_field).cast("string")
    skipped = df.where(ts.isNull()).select(
        raw.alias("timestamp_text"),
        F.when(raw.isNull() | (raw == ""), "no timestamp").otherwise("timestamp not readable").alias("reason"),
    )
    return rows.select(
        "batch_id", "ts", "variable", "value", "uncertainty", F.coalesce("unit", "row_unit").alias("unit"), "method"
    ), skipped


def explode_data(df: DataFrame, column: str = "data") -> DataFrame:
    """One row per element of a landed response body with its fields as columns."""
    return df.select(F.explode(column).alias("r")).select("r.*")


# --- ELN ----------------------------------------------------------------------------------------------------------


def notebook_results(
    df: DataFrame, mapping: SourceMapping, batch_id: str | Column
) -> tuple[DataFrame, DataFrame]:
    """(assay rows, observations) of landed results with name, value, unit and time attributes.

    Mapped numeric results are assays. Text results, mapped or not, become one observation map per batch
    (the newest text of each name).
    """
    bid = F.lit(batch_id) if isinstance(batch_id, str) else batch_id
    attributes = df.select(bid.alias("batch_id"), "attributes.*") if "attributes" in df.columns else df.select(
        bid.alias("batch_id"), "*"
    )
    candidates = [c for c in (mapping.timestamp_field, "created_at") if c in attributes.columns]
    if not candidates:
        raise ValueError("results have no time attribute")
    raw_ts = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in dict.fromkeys(candidates)])
    unit = F.col("unit").cast("string") if "unit" in attributes.columns else F.lit(None).cast("string")
    table = df.sparkSession.createDataFrame(
        [(m.source, m.target, m.unit) for m in mapping.variables], "name string, target string, mapped_unit string"
    )
    rows = attributes.select(
        "batch_id", F.col("name").cast("string").alias("name"), F.col("value").cast("string").alias("text"),
        unit.alias("row_unit"), S.parse_timestamp(raw_ts).alias("ts"),
    ).where("ts is not null").join(F.broadcast(table), "name", "left")
    number = S.numeric(F.col("text"))
    assay = rows.where(F.col("target").isNotNull() & number.isNotNull()).select(
        "batch_id", "ts", F.col("target").alias("variable"), number.alias("value"), F.lit(0.0).alias("uncertainty"),
        F.coalesce("mapped_unit", "row_unit", F.lit("")).alias("unit"), F.lit("eln").alias("method"),
    )
    texts = rows.where(number.isNull() & (F.col("text").isNotNull() | F.col("target").isNotNull()))
    newest = texts.groupBy("batch_id", "name").agg(
        F.max_by(F.coalesce("text", F.lit("None")), F.struct("ts", "text")).alias("text")
    )
    # a batch has as many observations as distinct result names
    observations = newest.groupBy("batch_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("observations")
    )
    return assay, observations
