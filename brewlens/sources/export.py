"""Export of batches as CSV, Parquet or Arrow IPC files."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brewlens.operators.timeseries import union_assay
from brewlens.plans.ordered import PIECE
from brewlens.plans.skew import spread

FORMATS = ("arrow", "csv", "parquet")
FORMS = ("aligned", "original")
LISTING = "file string, n_rows long"
#: Width in time of what one task writes of one batch: a quarter.
QUARTER = 92 * PIECE


def aligned_rows(telemetry: DataFrame, assay: DataFrame | None) -> DataFrame:
    """Canonical rows for export: telemetry, and assay rows when given."""
    return telemetry if assay is None else union_assay(telemetry, assay)


def original_rows(original: DataFrame, headers: list[str]) -> DataFrame:
    """Raw text as it was in the file, one column per header."""
    return original.where(F.col("headers") == F.array(*[F.lit(h) for h in headers])).select(
        *[F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(h) for i, h in enumerate(headers)]
    )


def export_original(original: DataFrame, path: str, fmt: str = "csv") -> list[DataFrame | None]:
    """Raw text of one batch. Files of several layouts go to one folder each below ``path`` (``layout=0`` and so on)."""
    layouts = [r["headers"] for r in original.select("headers").distinct().orderBy("headers").collect()]  # a row a layout
    folders = [path] if len(layouts) == 1 else [f"{path}/layout={i}" for i in range(len(layouts))]
    return [
        export(original_rows(original, headers), folder, fmt) for headers, folder in zip(layouts, folders, strict=True)
    ]


def _writer(df: DataFrame, partition_by: list[str] | None) -> DataFrameWriter:
    """With folders, tasks put their files in place themselves; the driver would move one folder after the other. As the
    target must be new and names of repeated tasks are equal, ``_SUCCESS`` tells a whole export from a broken one.
    """
    writer = df.write.mode("errorifexists")
    if not partition_by:
        return writer
    return writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*partition_by)


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = _writer(df, partition_by).option("header", True)
    writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    _writer(df, partition_by).parquet(path)


def arrow_uri(spark: SparkSession, path: str) -> str:
    """``path`` on its own or the cluster's default file system, as a URI that Arrow's file systems know."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()
    scheme, _, rest = full.partition(":")
    if scheme == "file":
        return f"file:///{rest.lstrip('/')}"
    return f"s3:{rest}" if scheme == "s3a" else full


def write_arrow(df: DataFrame, path: str) -> DataFrame:
    """One Arrow IPC file per non-empty partition; returns their listing (file, n_rows), kept in ``path/_files``.

    A path without a scheme lies on the cluster's default file system. A file's name is its partition number and it
    appears by a rename, so a repeated task replaces its own file instead of adding one; what a lost task left
    unfinished is deleted at the end.
    """
    spark = df.sparkSession
    target = arrow_uri(spark, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        filesystem, root = fs.FileSystem.from_uri(target)
        filesystem.create_dir(root, recursive=True)
        name = f"part-{context.partitionId():05d}.arrow"
        partial = posixpath.join(root, f"{name}.{context.taskAttemptId()}.tmp")
        rows, sink, writer = 0, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if writer is None:
                sink = filesystem.open_output_stream(partial)
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            filesystem.move(partial, posixpath.join(root, name))
            yield pa.RecordBatch.from_pydict({"file": [f"{target}/{name}"], "n_rows": pa.array([rows], pa.int64())})

    df.mapInArrow(write, LISTING).write.parquet(f"{target}/_files")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for left in filesystem.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "*.tmp")) or []:
        filesystem.delete(left.getPath(), False)
    return spark.read.schema(LISTING).parquet(f"{target}/_files")


def read_arrow(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of the files that :func:`write_arrow` lists, batch by batch."""
    files = spark.read.schema(LISTING).parquet(f"{arrow_uri(spark, path)}/_files")
    names = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file in batch.column("file").to_pylist():
                filesystem, at = fs.FileSystem.from_uri(file)
                with filesystem.open_input_file(at) as source:
                    found = pa.ipc.open_file(source)
                    for i in range(found.num_record_batches):
                        yield found.get_batch(i).select(names)

    return files.repartition("file").mapInArrow(read, schema)


def check_target(path: str, allowed_root: str | None) -> str:
    """The normalised target, which must lie below ``allowed_root`` when that is given."""
    clean = posixpath.normpath(path) if "://" not in path else path
    if ".." in path.split("/"):
        raise ValueError(f"output path '{path}' must not contain '..'")
    if allowed_root is not None:
        root = allowed_root.rstrip("/") if "://" in allowed_root else posixpath.normpath(allowed_root)
        if clean != root and not clean.startswith(root + "/"):
            raise ValueError(f"output path '{path}' is outside '{allowed_root}'")
    return clean


def by_batch(df: DataFrame) -> DataFrame:
    """Rows of one batch (and quarter) in one partition, for writers of a folder per batch: many batches then make one small
    file each, not one for each task that holds some of their rows; a batch that runs for long is written by several tasks.
    """
    quarter = F.floor(F.unix_micros("ts") / F.lit(QUARTER))
    return spread(df.withColumn("_quarter", quarter), "batch_id", "_quarter").drop("_quarter")


def export(df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None) -> DataFrame | None:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format '{fmt}', must be one of {sorted(FORMATS)}")
    if df.isEmpty():
        raise ValueError("no data to export")
    if partition_by == ["batch_id"]:
        df = by_batch(df)
    if fmt == "csv":
        return write_csv(df, path, partition_by)
    if fmt == "parquet":
        return write_parquet(df, path, partition_by)
    return write_arrow(df, path)
