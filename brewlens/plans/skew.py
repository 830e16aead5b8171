"""Partitioning by key, and the filter of one tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into ``spark.sql.shuffle.partitions`` parts and keep that number.

    For steps whose cost is computation rather than bytes, where merging small partitions at run time
    would leave most cores idle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def tenant_scope(df: DataFrame, tenant_id: str) -> DataFrame:
    """The rows of one tenant; every tenant-facing read goes through this filter."""
    if not tenant_id:
        raise ValueError("tenant_id is required")
    return df.where(F.col("tenant_id") == F.lit(tenant_id))
