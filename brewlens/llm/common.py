"""Helpers the operators share: column picking, shared scratch folders, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (loads pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brewlens.session import ensure_checkpoint_dir

#: White space of the contracts: a word is a maximal run of other characters.
SPACE = r"[\x20\x09-\x0D]+"


class Scratch:
    """Folders made while ``with`` holds the scope, to be deleted by whoever opened it, and by no one else."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        Scratch._open.remove(self)

    def release(self) -> None:
        """Delete the folders; nothing may be read any more from a plan that was built in this scope."""
        for path in self.paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths.clear()


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of ``spark.checkpoint.dir``; every executor can read it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A :func:`shared` folder that belongs to the innermost open :class:`Scratch`, if there is one."""
    path = shared(spark, name)
    if Scratch._open:
        Scratch._open[-1].paths.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _positions(df: DataFrame, names: Iterable[str]) -> list[int]:
    found = []
    for name in names:
        exact = [i for i, c in enumerate(df.columns) if c == name]
        loose = exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not loose:
            raise ValueError(f"no column {name} among {df.columns}")
        found.append(loose[0])
    return found


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns under new names (``new="old"``); other columns cannot clash, whatever their names."""
    at = _positions(df, names.values())
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{i}").alias(new) for new, i in zip(names, at, strict=True)])


def packed(df: DataFrame, **names: str) -> DataFrame:
    """As :func:`pick`, with the whole row in a struct column ``row`` besides; ``select("row.*")`` gives it back."""
    at = _positions(df, names.values())
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    whole = F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
    return flat.select(*[F.col(f"c{i}").alias(new) for new, i in zip(names, at, strict=True)], whole.alias("row"))


def numbered(df: DataFrame, name: str, **names: str) -> DataFrame:
    """:func:`packed` rows in the shared folder, each with a number ``rid`` of its own that later reads find unchanged."""
    return stored(packed(df, **names).withColumn("rid", F.monotonically_increasing_id()), name)


def only(rows: DataFrame, rids: DataFrame) -> DataFrame:
    """The original columns of those ``numbered`` rows whose ``rid`` is among ``rids``; no key of this join is hot."""
    return rows.join(rids.select("rid"), "rid", "left_semi").select("row.*")


def text_of(column: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one slice holds about ``most`` bytes of text (one longer text is a slice of its own)."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def partitions(df: DataFrame) -> int:
    """How many tasks an ordered exchange gets."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
