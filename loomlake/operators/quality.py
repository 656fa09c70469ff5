"""Expectations derived from a profile, and their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.operators.profile import melted, profile
from loomlake.session import durable

SET_SIZE = 10


def suite_of(p: DataFrame, words: DataFrame) -> DataFrame:
    """(expectation_type, column_name, lo, hi, allowed): what a profile, and the values of columns with few, lead one to expect.

    The five kinds: row count, no nulls (where the rounded share of nulls is 0, so
    that one null in very many rows is found to fail), uniqueness (where all values
    differ), numeric range, and membership (up to ten different values).
    """
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    kind = lambda name, column, lo=none, hi=none, allowed=F.lit(None).cast("array<string>"): [F.lit(name).alias("expectation_type"), column.alias("column_name"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), allowed.alias("allowed")]
    n = p.agg(F.max("n_rows").alias("n")).where("n is not null")
    c = F.col("column_name")
    return (
        n.select(*kind("row_count", text, F.col("n"), F.col("n")))
        .unionByName(p.where("null_pct = 0").select(*kind("not_null", c)))
        .unionByName(p.where("unique_count = n_rows").select(*kind("unique", c)))
        .unionByName(p.where("min_value is not null").select(*kind("between", c, F.col("min_value"), F.col("max_value"))))
        .unionByName(words.select(*kind("in_set", c, none, none, F.col("seen"))))
    )


def _seen(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, seen): the different non-null values of columns known to have few."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, seen array<string>")
    return melted(df.select(*columns)).where("value is not null").groupBy("column_name").agg(F.array_sort(F.collect_set("value")).alias("seen"))


def held(suite: DataFrame, p: DataFrame, words: DataFrame) -> DataFrame:
    """Each expectation with its outcome on a profiled table: (expectation_type, column_name, success, observed_value).

    row_count: lo to hi rows.  not_null and unique: by column, nulls left out of
    uniqueness.  between: lo to hi, nulls left out.  in_set: allowed values, nulls
    left out; ``words`` has the values of the columns concerned.
    """
    total = F.lit(p.agg(F.coalesce(F.max("n_rows"), F.lit(0))).first()[0])  # one row
    joined = suite.join(p, "column_name", "left").join(words, "column_name", "left").withColumn("total", total)
    kind, c = F.col("expectation_type"), F.col
    outside = F.size(F.array_except("seen", "allowed"))
    ok = (
        F.when(kind == "row_count", c("total").between(c("lo"), c("hi")))
        .when(kind == "not_null", F.coalesce("null_count", F.lit(0)) == 0)
        .when(kind == "unique", F.coalesce(c("unique_count") == c("n_rows") - c("null_count"), F.lit(True)))
        .when(kind == "between", F.coalesce((c("min_value") >= c("lo")) & (c("max_value") <= c("hi")), F.lit(True)))
        .when(kind == "in_set", F.coalesce(outside == 0, F.lit(True)))
    )
    seen = (
        F.when(kind == "row_count", c("total").cast("string"))
        .when(kind == "not_null", F.coalesce("null_count", F.lit(0)).cast("string"))
        .when(kind == "unique", c("unique_count").cast("string"))
        .when(kind == "between", F.concat_ws("..", "min_value", "max_value"))
        .when(kind == "in_set", F.array_join("seen", "|"))
    )
    return joined.select("expectation_type", "column_name", ok.alias("success"), seen.alias("observed_value"))


def _profiled(df: DataFrame) -> tuple[DataFrame, list]:
    """The profile as a table of its own, computed once: it has one row per column."""
    p = profile(df)
    found = p.collect()
    return df.sparkSession.createDataFrame(found, p.schema), found


def expectations(df: DataFrame) -> DataFrame:
    """The suite derived from a table, held against the table itself: one row per expectation."""
    p, found = _profiled(df)
    words = durable(_seen(df, [r["column_name"] for r in found if 0 < r["unique_count"] <= SET_SIZE]))
    return held(suite_of(p, words), p, words)


def summary(results: DataFrame) -> DataFrame:
    """success, expectations, successful, failed of a suite."""
    return results.agg(
        F.bool_and("success").alias("success"), F.count("*").alias("expectations"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed")
    )


def checked(df: DataFrame, suite: DataFrame) -> DataFrame:
    """Hold another load of a table against a suite of (expectation_type, column_name, lo, hi, allowed)."""
    columns = [r[0] for r in suite.where("expectation_type = 'in_set'").select("column_name").distinct().collect() if r[0] in df.columns]
    listed = suite.where("expectation_type = 'in_set'").select("column_name", "allowed")
    # of columns with many values only one that is not allowed is kept, enough to fail
    words = melted(df.select(*columns)).where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n")) if columns else None
    seen = _seen(df, []) if words is None else words.join(F.broadcast(listed), "column_name").groupBy("column_name").agg(F.array_compact(F.array(F.min(F.when(~F.array_contains("allowed", F.col("value")), F.col("value"))))).alias("seen"))
    return held(suite, _profiled(df)[0], seen).drop("observed_value")


def profiled_tables(tables: dict[str, DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """Suites of several tables, with table_name; a table that fails is reported by its error and does not stop the others."""
    out, errors = None, {}
    for name, df in tables.items():
        try:
            part = durable(expectations(df).withColumn("table_name", F.lit(name)))  # run here, so that a failure belongs to its table
        except Exception as e:  # noqa: BLE001 - the error is the result
            errors[name] = str(e)[:500]
            continue
        out = part if out is None else out.unionByName(part)
    return out, errors
