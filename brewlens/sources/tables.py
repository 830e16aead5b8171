"""Stored tables as partitioned Parquet.

Tables keyed by batch are partitioned by a hash bucket of ``batch_id``: one batch reads one bucket, and
the number of folders does not grow with the number of batches. Writes are plain appends.

A load writes several tables. Its rows carry the name of the attempt that wrote them, and readers see them once a row of
``loads`` names that attempt, which is written last: a load is visible as a whole or not at all. Readers join ``loads`` by
an equi-join; :meth:`TableStore.compact` writes visible rows without attempts, so that ``loads`` begins anew.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brewlens import schemas

BUCKETS = 256

_LOG = T.StructType([
    T.StructField("_version", T.LongType()), T.StructField("_deleted", T.BooleanType()),
    T.StructField("_cascade", T.BooleanType()),
])
_PHASE_LOG = T.StructType([
    T.StructField("method", T.StringType()), T.StructField("_version", T.LongType()),
    T.StructField("_deleted", T.BooleanType()),
])
_ORIGINAL = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("headers", T.ArrayType(T.StringType())),
    T.StructField("fields", T.ArrayType(T.StringType())),
])

LAYOUT: dict[str, T.StructType] = {
    "telemetry": schemas.TELEMETRY,
    "assay": schemas.ASSAY,
    "phases": T.StructType(schemas.PHASES.fields + _PHASE_LOG.fields),
    "operations": schemas.OPERATIONS,
    "metrics": schemas.METRICS,
    "original": _ORIGINAL,
    "batches": T.StructType(schemas.BATCHES.fields + _LOG.fields),
    "golden_profiles": schemas.GOLDEN_PROFILES,
    "audit": T.StructType([*schemas.AUDIT.fields, T.StructField("_version", T.LongType())]),
    "audit_heads": T.StructType([
        T.StructField("tenant_id", T.StringType()), T.StructField("last_seq", T.LongType()),
        T.StructField("last_hash", T.StringType()), T.StructField("_version", T.LongType()),
    ]),
    "checkpoints": T.StructType([
        T.StructField("tenant_id", T.StringType()), T.StructField("size", T.LongType()),
        T.StructField("root", T.StringType()), T.StructField("saved_at", T.TimestampType()),
    ]),
    "users": schemas.USERS,
    "loads": T.StructType([
        T.StructField("load_id", T.StringType()), T.StructField("attempt", T.StringType()),
        T.StructField("loaded_at", T.TimestampType()),
    ]),
    "sensors": T.StructType(schemas.SENSORS.fields + _LOG.fields[:2]),
}
BY_BATCH = ("telemetry", "assay", "phases", "operations", "metrics", "original")
#: Tables that loads write; the attempt is kept in a column of the files alone.
LOADED = ("batches", "telemetry", "assay", "original")


class TableStore:
    """Reads and appends the tables of :data:`LAYOUT` below one root folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def path(self, table: str) -> str:
        if table not in LAYOUT:
            raise ValueError(f"unknown table: {table}")
        return f"{self.root}/{table}"

    def _bucket(self, batch_id):
        return F.pmod(F.xxhash64(batch_id), F.lit(self.buckets)).cast("int")

    def _files(self, table: str) -> DataFrame | None:
        """All rows of the files with their bucket and attempt; None when nothing was written yet."""
        extra = [T.StructField("bucket", T.IntegerType())] if table in BY_BATCH else []
        extra += [T.StructField("_load", T.StringType())] if table in LOADED else []
        schema = T.StructType([*LAYOUT[table].fields, *extra])
        try:
            return self.spark.read.schema(schema).parquet(self.path(table))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _visible(self, table: str, rows: DataFrame | None) -> DataFrame:
        """Rows written outside loads (no attempt) and those of attempts that ``loads`` names."""
        if rows is None:
            return self.spark.createDataFrame([], LAYOUT[table])
        names = LAYOUT[table].names
        if table not in LOADED:
            return rows.select(*names)
        loads = self._files("loads")
        if loads is None:
            return rows.where("_load is null").select(*names)
        first = F.min_by("attempt", F.struct("loaded_at", "attempt")).alias("_load")
        attempts = loads.groupBy("load_id").agg(first).select("_load")
        seen = attempts.unionByName(self.spark.range(1).select(F.lit("").alias("_load")))
        return rows.withColumn("_load", F.coalesce("_load", F.lit(""))).join(seen, "_load", "left_semi").select(*names)

    def read(self, table: str) -> DataFrame:
        """The whole table under its declared schema; empty when nothing was written yet."""
        return self._visible(table, self._files(table))

    def read_batch(self, table: str, batch_id: str) -> DataFrame:
        """Rows of one batch; only its bucket folder is listed and read."""
        same = (F.col("bucket") == self._bucket(F.lit(batch_id))) & (F.col("batch_id") == F.lit(batch_id))
        rows = self._files(table)
        return self._visible(table, None if rows is None else rows.where(same))

    def commit(self, load_id: str, attempt: str) -> None:
        """Make the rows of an attempt visible. Of several attempts at one load the first counts."""
        row = self.spark.range(1).select(
            F.lit(load_id).alias("load_id"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("loaded_at")
        )
        self.append("loads", row)

    def append(self, table: str, rows: DataFrame, attempt: str | None = None) -> None:
        """Append rows; partition sizes are rebalanced at run time, which also splits hot buckets.

        Rows of an ``attempt`` at a load are seen after its :meth:`commit`.
        """
        if attempt is not None and table not in LOADED:
            raise ValueError(f"loads do not write {table}")
        schema = LAYOUT[table]
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        if table in LOADED:
            typed = typed.withColumn("_load", F.lit(attempt).cast("string"))
        if table in BY_BATCH:
            typed = typed.withColumn("bucket", self._bucket(F.col("batch_id")))
            typed.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(self.path(table))
        else:
            typed.write.mode("append").parquet(self.path(table))

    def compact(self, table: str, target: str) -> None:
        """Write the table again with fewer, larger files below another root."""
        TableStore(self.spark, target, self.buckets).append(table, self.read(table))


def upload_problems(
    spark: SparkSession, path: str, kind: str = "telemetry", most_bytes: int | None = None
) -> DataFrame:
    """(file, problem) for Parquet files that exceed ``most_bytes`` (if given), are empty, unreadable or lack columns.

    The listing reads no content; row counts come from one pass with the declared schema.
    """
    declared = {"telemetry": schemas.TELEMETRY, "assay": schemas.ASSAY}[kind]
    listing = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    too_large = listing.where(F.lit(most_bytes is not None) & (F.col("length") > F.lit(most_bytes or 0))).select("file", F.lit("file too large").alias("problem"))
    found = spark.read.option("mergeSchema", "false").parquet(path)
    wrong = [
        f"column {f.name} missing" if f.name not in found.columns else f"column {f.name} is not {f.dataType.simpleString()}"
        for f in declared.fields
        if f.name not in found.columns or found.schema[f.name].dataType != f.dataType
    ]
    problems = too_large
    if wrong:
        bad = listing.withColumn("problem", F.explode(F.array(*[F.lit(w) for w in wrong])))
        return problems.unionByName(bad.select("file", "problem"))
    rows = (
        spark.read.schema(declared).option("ignoreCorruptFiles", "true").parquet(path)
        .groupBy(F.col("_metadata.file_path").alias("file")).count()
    )
    # both listings name files as URIs; compare by the part behind the scheme
    tail = F.regexp_replace("file", "^[a-z0-9]+:/+", "/")
    empty = listing.withColumn("k", tail).join(rows.select(tail.alias("k")), "k", "left_anti")
    return problems.unionByName(empty.select("file", F.lit("empty or unreadable").alias("problem")))
