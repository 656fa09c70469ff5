"""Parquet table access by name below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan ``folder/name.parquet`` (one file or a folder of part files)."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_delivery(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: a record delivered again keeps its first load.

    Repeats carry the same values except ``load_id`` and ``loaded_at``; ties in
    both are broken by the values, so that the result is deterministic.  A null
    key identifies nothing: such rows are all kept.  Result: key, load_id,
    loaded_at and ``columns``.
    """
    keep = ["load_id", "loaded_at", *[c for c in columns if c not in ("load_id", "loaded_at")]]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*keep))  # limited to one row a key before the shuffle, too
    one = df.where(F.col(key).isNotNull()).select(key, *keep).withColumn("_first", first).where("_first = 1").drop("_first")
    return one.unionByName(df.where(F.col(key).isNull()).select(key, *keep))
