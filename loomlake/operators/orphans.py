"""References to records that do not exist.

References and parent keys are co-partitioned by key, sorted, and merged in one
pass over both streams (Spark's sort-merge join, asked for by hint).  A parent
stream carries one validity interval per key: from its first load to its logged
deletion.  Keys that hold a large share of all references never enter the
merge: they are found by a one-pass frequent-items sketch, which has no false
negatives and at most 1/support entries, and are looked up by a small broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.sources.tables import table

#: A key with at least this share of one column's references is a hot key; so there are at most 1/HOT_SHARE (x2, by the sketch) of them.
HOT_SHARE = 0.01


@dataclass(frozen=True)
class Reference:
    table: str
    key: str
    field: str
    parent: str
    parent_key: str


CLINIC_REFERENCES = (
    Reference("visits", "visit_id", "patient_id", "patients", "patient_id"),
    Reference("billing", "billing_id", "visit_id", "visits", "visit_id"),
    Reference("billing", "billing_id", "patient_id", "patients", "patient_id"),
)


def normal_key(c: Column) -> Column:
    """Surrounding spaces and letter case of a reference do not matter."""
    return F.upper(F.trim(c))


def parent_intervals(parents: DataFrame, key: str, deletions: DataFrame, parent_table: str) -> DataFrame:
    """One row per key that was ever loaded or logged as deleted: (pkey, first_loaded, deleted_at).

    ``first_loaded`` is null for a key known only from the deletion log.  Of
    repeated log entries the last counts.  Null keys identify nothing and are left out.
    """
    alive = parents.where(F.col(key).isNotNull()).select(
        normal_key(F.col(key)).alias("pkey"), F.col("loaded_at").alias("first_loaded"), F.lit(None).cast("timestamp_ntz").alias("deleted_at")
    )
    gone = deletions.where((F.col("table_name") == parent_table) & F.col("record_key").isNotNull()).select(
        normal_key(F.col("record_key")).alias("pkey"), F.lit(None).cast("timestamp_ntz").alias("first_loaded"), "deleted_at"
    )
    return alive.unionByName(gone).groupBy("pkey").agg(F.min("first_loaded").alias("first_loaded"), F.max("deleted_at").alias("deleted_at"))


def hot_keys(refs: DataFrame, share: float = HOT_SHARE) -> list[str]:
    """Keys that may hold ``share`` of the rows or more: a superset, of bounded size, by one pass without a shuffle."""
    found = refs.select("rkey").freqItems(["rkey"], share).collect()
    return [k for k in (found[0][0] or []) if k is not None] if found else []


def matched(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Left merge of references (column rkey) with parent intervals (column pkey)."""
    hot = hot_keys(refs)
    is_hot = F.col("rkey").isin(hot) if hot else F.lit(False)
    cold = refs.where(~is_hot)
    merged = cold.join(parents.hint("merge"), cold["rkey"] == parents["pkey"], "left")
    if not hot:
        return merged
    few = parents.where(F.col("pkey").isin(hot))
    warm = refs.where(is_hot)
    return merged.unionByName(warm.join(F.broadcast(few), warm["rkey"] == few["pkey"], "left"))


def reference_rows(spark: SparkSession, folder: str, ref: Reference) -> DataFrame:
    return (
        table(spark, folder, ref.table)
        .where(F.col(ref.field).isNotNull())
        .select(
            F.lit(ref.table).alias("table_name"),
            F.col(ref.key).alias("record_key"),
            F.lit(ref.field).alias("field_name"),
            normal_key(F.col(ref.field)).alias("rkey"),
            "load_id",
            "loaded_at",
        )
    )


def classified(spark: SparkSession, folder: str, refs: tuple[Reference, ...] = CLINIC_REFERENCES) -> DataFrame:
    """Every non-null reference of every delivery with its ``status``.

    ``ok``: the key was loaded by the time of the reference and not deleted before it.
    ``late``: the parent was loaded after the reference.
    ``expired``: the parent is in its table, but its deletion is logged before the reference was loaded.
    ``deleted``: no row has the key, but a deletion is logged.  ``missing``: neither.
    """
    out = None
    deletions = table(spark, folder, "deleted_records")
    for ref in refs:
        parents = parent_intervals(table(spark, folder, ref.parent), ref.parent_key, deletions, ref.parent)
        status = (
            F.when(F.col("first_loaded").isNull() & F.col("deleted_at").isNotNull(), "deleted")
            .when(F.col("first_loaded").isNull(), "missing")
            .when(F.col("first_loaded") > F.col("loaded_at"), "late")
            .when((F.col("deleted_at") >= F.col("first_loaded")) & (F.col("deleted_at") < F.col("loaded_at")), "expired")
            .otherwise("ok")
        )
        part = matched(reference_rows(spark, folder, ref), parents).select(
            "table_name", "record_key", "field_name", "rkey", "load_id", "loaded_at", status.alias("status")
        )
        out = part if out is None else out.unionByName(part)
    return out


def orphan_references(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, record_key, field_name) of each reference whose key is in no row of the referred table.

    Empty text is a reference too (to no key).  Null references are none.  A
    record delivered twice comes out once.
    """
    found = classified(spark, folder).where(F.col("status").isin("missing", "deleted"))
    return found.select("table_name", "record_key", "field_name").distinct()


def orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    """References that are not ok, counted per table, field, month of first load and status."""
    bad = classified(spark, folder).where(F.col("status") != "ok")
    once = bad.groupBy("table_name", "field_name", "record_key").agg(F.min(F.struct("loaded_at", "status")).alias("f"))
    return (
        once.groupBy("table_name", "field_name", F.date_format("f.loaded_at", "yyyy-MM").alias("load_month"), F.col("f.status").alias("status"))
        .agg(F.count("*").alias("n_references"))
    )
