"""Files and tables around the engine: CSV folders, JSON artifacts, JSON-lines logs, pushed rows, catalogs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from loomlake.functions.expressions import na_to_null


def _children(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(path)) if fs.exists(path) else []


def csv_folder(spark: SparkSession, folder: str, schemas: dict[str, StructType | str]) -> dict[str, DataFrame]:
    """bronze_<stem> for each *.csv of a folder, in name order; types come from ``schemas`` (text where a stem has none).

    Header row; texts that mean missing become null, in numeric columns too.
    """
    out = {}
    for path in _children(spark, folder):
        m = re.search(r"([^/]+)\.csv$", path)
        if not m:
            continue
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        raw = reader.csv(path)
        typed = {}
        if m.group(1) in schemas:
            wanted = schemas[m.group(1)]
            fields = wanted.fields if isinstance(wanted, StructType) else StructType.fromDDL(wanted).fields
            typed = {f.name: f.dataType for f in fields}
        columns = []
        for c in raw.columns:
            x = na_to_null(F.col(f"`{c}`"))
            columns.append((x.try_cast(typed[c]) if c in typed else x).alias(c))
        out[f"bronze_{m.group(1)}"] = raw.select(*columns)
    return out


def tables_like(spark: SparkSession, pattern: str, views_only: bool = False) -> list[str]:
    """Tables and views of the catalog whose names match an SQL pattern, letter case aside; sorted."""
    shape = re.compile("".join({"%": ".*", "_": "."}.get(ch, re.escape(ch)) for ch in pattern), re.IGNORECASE | re.DOTALL)
    return sorted(t.name for t in spark.catalog.listTables() if shape.fullmatch(t.name) and (not views_only or t.tableType in ("VIEW", "TEMPORARY")))


def columns_of(spark: SparkSession, name: str) -> list[str]:
    return spark.table(name).columns


def read_artifact(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame | None:
    """A JSON artifact, or null where there is none."""
    if not _children(spark, path) and not path.endswith(".json"):
        return None
    try:
        reader = spark.read.option("multiLine", path.endswith(".json"))
        return (reader.schema(schema) if schema else reader).json(path)
    except AnalysisException:
        return None


def write_artifact(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(events: DataFrame, path: str) -> None:
    """Append events to a JSON-lines log, with the time they were written (UTC)."""
    stamped = events.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    stamped.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON-lines log; lines that cannot be read come out as nulls, a missing log is empty."""
    if not _children(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def push_rows(rows: DataFrame, known: DataFrame, path: str, batch: str) -> int:
    """Append (dataset_id, table_name, row) rows of known tables to the push store; how many were taken.

    Rows for unknown tables raise.  A batch written before is replaced, not
    doubled: the store is partitioned by batch.
    """
    unknown = rows.join(known, ["dataset_id", "table_name"], "left_anti").limit(1).count()
    if unknown:
        raise LookupError("rows for a dataset or table that is not known")
    stored = rows.withColumn("batch", F.lit(batch))
    stored.write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(path)
    return stored.count()


def pushed_rows(spark: SparkSession, path: str, dataset_id: str | None = None, table_name: str | None = None) -> DataFrame:
    """Rows pushed so far; an unused store is empty."""
    if not _children(spark, path):
        return spark.createDataFrame([], "dataset_id string, table_name string, row string, batch string")
    d = spark.read.parquet(path)
    if dataset_id is not None:
        d = d.where(F.col("dataset_id") == dataset_id)
    return d if table_name is None else d.where(F.col("table_name") == table_name)


def push_counts(pushed: DataFrame) -> DataFrame:
    return pushed.groupBy("dataset_id", "table_name").agg(F.count("*").alias("n_rows"))


def replace_collections(docs: DataFrame, path: str) -> None:
    """Write documents, one partition per collection; collections not written stay as they are."""
    docs.write.mode("overwrite").partitionBy("collection").option("partitionOverwriteMode", "dynamic").parquet(path)


def collection_counts(spark: SparkSession, path: str) -> DataFrame:
    """(collection, n_documents); an unused store is empty."""
    if not _children(spark, path):
        return spark.createDataFrame([], "collection string, n_documents long")
    return spark.read.parquet(path).groupBy("collection").agg(F.count("*").alias("n_documents"))
