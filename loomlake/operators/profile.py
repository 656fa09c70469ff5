"""Column profiles by melting: one pass over the cells, then counted values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.expressions import dtype_label, finite

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def melted(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(column_name, value, number): the cells as text and, of numeric columns, as finite numbers; NaN is a missing value."""
    cells = []
    for c, t in df.dtypes:
        if c in (extra or []):
            continue
        x = F.col(c)
        missing = F.isnan(x) if t in ("double", "float") else F.lit(False)
        x = x + F.lit(0.0).cast(t) if t in ("double", "float") else x  # one zero, whatever its sign
        text = F.when(~missing, x.cast("string"))
        number = finite(x.cast("double")) if is_numeric(t) else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(c).alias("column_name"), text.alias("value"), number.alias("number")))
    return df.select(*(extra or []), F.explode(F.array(*cells)).alias("c")).select(*(extra or []), "c.*")


def profile(df: DataFrame) -> DataFrame:
    """(column_name, data_type, n_rows, null_count, null_pct, unique_count, min_value, max_value, mean_value, min_length, max_length).

    Numeric columns have extrema and mean (over finite values), text columns lengths
    (over non-null values).  An empty table has no rows in its profile.
    """
    counted = melted(df).groupBy("column_name", "value").agg(F.count("*").alias("n"), F.max("number").alias("number"))
    kinds = {c: t for c, t in df.dtypes}
    label, number = F.lit(None).cast("string"), F.lit(False)
    for c, t in kinds.items():
        label = F.when(F.col("column_name") == c, dtype_label(t)).otherwise(label)
        number = F.when(F.col("column_name") == c, is_numeric(t)).otherwise(number)
    n, v = F.col("n"), F.col("value")
    out = counted.groupBy("column_name").agg(
        F.sum(n).alias("n_rows"),
        F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("null_count"),
        F.count(v).alias("unique_count"),
        F.min("number").alias("min_value"),
        F.max("number").alias("max_value"),
        F.round(F.sum(F.col("number") * n) / F.sum(F.when(F.col("number").isNotNull(), n)), 2).alias("mean_value"),
        F.min(F.length(v)).alias("lo"),
        F.max(F.length(v)).alias("hi"),
    )
    return out.select(
        "column_name",
        label.alias("data_type"),
        "n_rows",
        "null_count",
        F.round(F.lit(100.0) * F.col("null_count") / F.col("n_rows"), 2).alias("null_pct"),
        "unique_count",
        "min_value",
        "max_value",
        "mean_value",
        F.when(~number, F.col("lo")).cast("long").alias("min_length"),
        F.when(~number, F.col("hi")).cast("long").alias("max_length"),
    )


def samples(df: DataFrame, order: list[str], k: int = 3) -> DataFrame:
    """(column_name, sample_values): the first ``k`` non-null values in the order of ``order``."""
    cells = melted(df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *df.columns), [f"_o{i}" for i in range(len(order))]).where("value is not null")
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(*[f"_o{i}" for i in range(len(order))]))
    top = cells.withColumn("r", rank).where(F.col("r") <= k)
    return top.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("sample_values"))
