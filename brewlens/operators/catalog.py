"""Batch catalog: search, ordering, validity rules, and insert/update/delete as log rows.

The stored catalog is an append-only log of row versions; the current catalog is the newest version per
batch. Every change is therefore one small append, and no file is ever rewritten in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brewlens.functions.scalars import finite
from brewlens.schemas import BATCHES, LIFECYCLES


@dataclass
class BatchFilter:
    """Optional conditions, all of which must hold."""

    strain: str | None = None
    media: str | None = None
    operator: str | None = None
    lifecycle: str | None = None
    tags: Sequence[str] = field(default_factory=list)
    inoculation_after: datetime | str | None = None
    inoculation_before: datetime | str | None = None
    name_contains: str | None = None

    def conditions(self) -> list[Column]:
        out: list[Column] = []
        for column, value in (
            ("meta_strain", self.strain),
            ("meta_media", self.media),
            ("meta_operator", self.operator),
            ("lifecycle", self.lifecycle),
        ):
            if value is not None:
                out.append(F.col(column) == F.lit(value))
        if self.name_contains is not None:
            out.append(F.contains(F.lower("name"), F.lower(F.lit(self.name_contains))))
        if self.inoculation_after is not None:
            out.append(F.col("ts_inoculation") >= F.lit(self.inoculation_after).cast("timestamp"))
        if self.inoculation_before is not None:
            out.append(F.col("ts_inoculation") < F.lit(self.inoculation_before).cast("timestamp"))
        out += [F.array_contains("tags", F.lit(tag)) for tag in self.tags]
        return out


def search_batches(batches: DataFrame, criteria: BatchFilter) -> DataFrame:
    for condition in criteria.conditions():
        batches = batches.where(condition)
    return batches


def newest_first(batches: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Batches by creation time, newest first; ties by id so that pages are stable."""
    ordered = batches.orderBy(F.col("created_at").desc_nulls_last(), F.col("batch_id").asc())
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def first_ranked(batches: DataFrame, rank_by: Column, n: int = 3) -> DataFrame:
    """The first ``n`` batches in the caller's order (a top-k plan, no full sort)."""
    return batches.orderBy(rank_by, "batch_id").limit(n)


def with_aliases(batches: DataFrame) -> DataFrame:
    """Catalog with the short metadata names next to the stored ones."""
    return batches.withColumns({
        "strain": F.col("meta_strain"),
        "media": F.col("meta_media"),
        "scale_liters": F.col("meta_scale_liters"),
        "operator": F.col("meta_operator"),
    })


# --- nested and flat form ----------------------------------------------------------------------------


def to_nested(batches: DataFrame) -> DataFrame:
    """One struct for the time marks and one for the metadata."""
    return batches.select(
        "batch_id", "name", "lifecycle",
        F.struct(
            F.col("ts_inoculation").alias("inoculation"), F.col("ts_feed_start").alias("feed_start"),
            F.col("ts_induction").alias("induction"), F.col("ts_harvest").alias("harvest"),
        ).alias("timestamps"),
        F.struct(
            F.col("meta_strain").alias("strain"), F.col("meta_media").alias("media"),
            F.col("meta_scale_liters").alias("scale_liters"), F.col("meta_operator").alias("operator"),
            F.col("meta_extra").alias("extra"),
        ).alias("metadata"),
        "tags", "created_at", "updated_at",
    )


def to_flat(nested: DataFrame) -> DataFrame:
    return nested.select(
        "batch_id", "name", "lifecycle",
        *[F.col(f"timestamps.{n}").alias(f"ts_{n}") for n in ("inoculation", "feed_start", "induction", "harvest")],
        *[F.col(f"metadata.{n}").alias(f"meta_{n}") for n in ("strain", "media", "scale_liters", "operator", "extra")],
        "tags", "created_at", "updated_at",
    )


def from_json_text(batches: DataFrame) -> DataFrame:
    """Read the form in which ``tags`` and ``meta_extra`` are JSON strings."""
    return batches.withColumns({
        "tags": F.from_json("tags", "array<string>"),
        "meta_extra": F.from_json("meta_extra", "map<string,string>"),
    })


def to_json_text(batches: DataFrame) -> DataFrame:
    return batches.withColumns({"tags": F.to_json("tags"), "meta_extra": F.to_json("meta_extra")})


# --- validity ------------------------------------------------------------------------------------------


def _split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``reason``); a rule gives true when it is broken."""
    reason = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    tagged = df.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def _not_finite(name: str) -> Column:
    return F.col(name).isNull() | finite(F.col(name)).isNull()


def validate_telemetry(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df, {
        "batch_id missing": _blank("batch_id"),
        "ts missing": F.col("ts").isNull(),
        "variable empty": _blank("variable"),
        "value not finite": _not_finite("value"),
    })


def validate_assay(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df, {
        "batch_id missing": _blank("batch_id"),
        "ts missing": F.col("ts").isNull(),
        "variable empty": _blank("variable"),
        "value not finite": _not_finite("value"),
        "uncertainty not finite": _not_finite("uncertainty"),
        "uncertainty negative": F.col("uncertainty") < 0,
    })


def validate_batches(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    scale = F.col("meta_scale_liters")
    return _split(df, {
        "batch_id missing": _blank("batch_id"),
        "name empty": _blank("name"),
        "lifecycle unknown": F.col("lifecycle").isNull() | ~F.col("lifecycle").isin(*LIFECYCLES),
        "scale not finite": scale.isNotNull() & finite(scale).isNull(),
        "scale not positive": scale <= 0,
    })


def validate_phases(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df, {
        "start_ts missing": F.col("start_ts").isNull(),
        "end_ts missing": F.col("end_ts").isNull(),
        "start after end": F.col("start_ts") > F.col("end_ts"),
    })


def validate_scores(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df, {"score outside 0..100": ~F.col("score").between(0, 100)})


# --- change log ----------------------------------------------------------------------------------------


def log_rows(batches: DataFrame, version: int, deleted: bool = False, cascade: bool = False) -> DataFrame:
    """Catalog rows as log rows of one version; ``cascade`` also hides the batch's measurements."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in BATCHES.fields]
    return batches.select(
        *cols, F.lit(version).cast("long").alias("_version"), F.lit(deleted).alias("_deleted"),
        F.lit(cascade).alias("_cascade"),
    )


def current_batches(log: DataFrame) -> DataFrame:
    """Newest version of each batch that is not deleted; one combined aggregation, no window."""
    names = [f.name for f in BATCHES.fields]
    newest = log.groupBy("batch_id").agg(
        F.max_by(F.struct(*names, "_deleted"), F.col("_version")).alias("row")
    )
    return newest.where(~F.col("row._deleted")).select("row.*").drop("_deleted")


def cascaded_ids(log: DataFrame) -> DataFrame:
    """Batches whose newest version is a cascading deletion."""
    newest = log.groupBy("batch_id").agg(F.max_by(F.struct("_deleted", "_cascade"), F.col("_version")).alias("r"))
    return newest.where("r._deleted and r._cascade").select("batch_id")


def duplicate_ids(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ids of ``incoming`` that exist already or occur twice in it."""
    exists = incoming.select("batch_id").join(current.select("batch_id"), "batch_id", "left_semi")
    repeated = incoming.groupBy("batch_id").count().where("count > 1").select("batch_id")
    return exists.unionByName(repeated).distinct()


def missing_ids(current: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("batch_id").join(current.select("batch_id"), "batch_id", "left_anti")


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Catalog after replacing the rows of ``changes`` by id and adding new ones."""
    untouched = current.join(changes.select("batch_id"), "batch_id", "left_anti")
    return untouched.unionByName(changes)


def remove(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of any table keyed by ``batch_id`` after deleting ``ids``."""
    return table.join(ids.select("batch_id"), "batch_id", "left_anti")


def latest_by(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """All rows of the newest version of each key."""
    newest = df.groupBy(*keys).agg(F.max(version).alias("_newest"))
    return df.join(newest, list(keys)).where(F.col(version) == F.col("_newest")).drop("_newest")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page rows, one-row frame ``has_next``) by fetching one row more than the page holds."""
    window = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = window.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    return (
        numbered.where(F.col("_rn") <= limit).drop("_rn"),
        window.agg((F.count(F.lit(1)) > limit).alias("has_next")),
    )
