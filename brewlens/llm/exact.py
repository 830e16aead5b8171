"""Exact duplicates through a persistent digest index, with DataFrame operations only.

The index is a table bucketed and sorted by digest: one row per known text, with the doc_id that stands for it.
New documents are grouped by digest (added up before the exchange), their digests go through a sort-merge
anti-join against the index, whose side needs no exchange, and those it lacks are appended. A batch whose text the
index knows is dropped in favour of the document it knows.

Texts are equal when identical after replacing every run of white space by one blank.

Defined cases: null text counts as empty; of equal texts the row with the smallest doc_id stays, null ids last, of
repeated rows exactly one; an empty table gives no rows and adds nothing; a clash of column names does not matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brewlens.llm.common import SPACE, numbered, only, pick, shared, stored, text_of

DIGEST = "digest binary, keep_id long, batch string"
#: Empty file beside the digests, followed by their bucket number; readers skip names with an underscore in front.
BESIDE = "_buckets-"


def digest(text: str = "text") -> Column:
    """SHA-256 (32 bytes) of the normalised text in UTF-8."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), SPACE, " ").cast("binary"), 256))


class DigestIndex:
    """A table of known digests at a shared path, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, name: str | None = None):
        self.spark = spark
        self.path = path or shared(spark, "digests")
        self.name = name or f"digests_{uuid.uuid4().hex}"
        self.buckets = self._written(buckets)
        if not spark.catalog.tableExists(self.name):
            # Files that an earlier session left at the path are the index again.
            spark.sql(
                f"CREATE TABLE {self.name} ({DIGEST}) USING parquet CLUSTERED BY (digest) SORTED BY (digest)"
                f" INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def _written(self, asked: int | None) -> int:
        """The bucket number kept in a file name beside the digests: a scan with fewer buckets would skip files.

        A new folder gets one; with digests but without the file, or with another number asked for, it is an error.
        """
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        known = {int(n.removeprefix(BESIDE)) for n in names if n.startswith(BESIDE)}
        if not known and any(n.startswith("part-") for n in names):
            raise ValueError(f"digests at {self.path} without their bucket number")
        if len(known) > 1 or (known and asked not in (None, *known)):
            raise ValueError(f"digests at {self.path} lie in {known} buckets, not {asked}")
        if known:
            return known.pop()
        chosen = asked or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        fs.mkdirs(folder)
        fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{BESIDE}{chosen}")).close()
        return chosen

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, digests: DataFrame) -> DataFrame:
        """Those of ``digests`` (one row each) that the index lacks: a sort-merge anti-join on its own buckets."""
        return digests.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, digests: DataFrame, batch: str) -> None:
        """Append what the index lacks under the name of a batch, one task a bucket.

        A batch appended again under its name adds nothing: its digests are there, and known as its own.
        """
        new = self.missing(digests).select("digest", "keep_id", F.lit(batch).alias("batch"))
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))


def _groups(rows: DataFrame) -> DataFrame:
    """One stored row per digest of rows (rid, doc_id, digest)."""
    return stored(
        rows.groupBy("digest").agg(_first().alias("first"), F.count("*").alias("group_size"))
        .select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "group_size"),
        "groups",
    )


def duplicates(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; the index then knows all of them.

    Digests enter the index before the caller has written anything. Name the ``batch`` to be able to run it again after a
    failure: the same name gives the same rows, and only texts that other batches brought are known ones.
    """
    batch = batch or uuid.uuid4().hex
    rows = stored(
        pick(docs, doc_id="doc_id", text="text")
        .select("doc_id", digest().alias("digest"), F.monotonically_increasing_id().alias("rid")),
        "rows",
    )
    groups = _groups(rows)
    index.append(groups, batch)
    known = index.rows().select("digest", F.col("keep_id").alias("known_id"), "batch")
    judged = stored(
        groups.join(known, "digest").select(
            "digest", "group_size", F.col("known_id").alias("keep_id"),
            F.when(F.col("batch") == batch, F.col("keep_rid")).alias("keep_rid"),
        ),
        "judged",
    )
    # Two plain scans meet, so adaptive execution can split the rows of one frequent text.
    return rows.join(judged, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows that stay, with all their columns; on ``batch`` see :func:`duplicates`."""
    batch = batch or uuid.uuid4().hex
    rows = numbered(docs, "documents", doc_id="doc_id", text="text")
    groups = _groups(rows.select("rid", "doc_id", digest().alias("digest")))
    index.append(groups, batch)
    new = index.rows().where(F.col("batch") == batch).select("digest")
    return only(rows, groups.join(new, "digest").select(F.col("keep_rid").alias("rid")))
