"""Bronze, silver and gold: cleaned raw tables, tables built from specs, renamed views."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions.expressions import na_to_null
from loomlake.operators.joins import skewed_join
from loomlake.plans.specs import TableSpec
from loomlake.sources.tables import first_delivery, table


def cleaned(df: DataFrame) -> DataFrame:
    """Texts that stand for a missing value become null."""
    return df.select(*[na_to_null(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def bronze(spark: SparkSession, folder: str, name: str, key: str, columns: list[str] | None = None) -> DataFrame:
    """A raw table with each record once."""
    raw = table(spark, folder, name)
    wanted = columns or [c for c in raw.columns if c not in (key, "load_id", "loaded_at")]
    return first_delivery(raw, key, [c for c in wanted if c != key])


def needed_columns(spec: TableSpec) -> dict[str, list[str]]:
    """The raw columns a spec reads, by table, join keys included."""
    need: dict[str, list[str]] = {spec.base: []}
    for j in spec.joins:
        need.setdefault(j.table, [])
    for c in spec.columns:
        for t, s in c.sources:
            if s not in need[t]:
                need[t].append(s)
    done = [spec.base]
    for j in spec.joins:
        if j.on not in need[j.table]:
            need[j.table].append(j.on)
        owner = join_owner(spec, j.on, done)
        if j.on not in need[owner]:
            need[owner].append(j.on)
        done.append(j.table)
    return need


def join_owner(spec: TableSpec, on: str, done: list[str]) -> str:
    """The table already joined that gives the key: the last that a column of the spec takes it from, else the base."""
    holders = [t for c in spec.columns for t, s in c.sources if s == on and t in done]
    return holders[-1] if holders else spec.base


def silver(spec: TableSpec, tables: dict[str, DataFrame], scans: dict[str, DataFrame] | None = None) -> DataFrame:
    """The spec's inner equi-joins and projections; only the columns it names are read.

    Rows whose join key is null match nothing.  A key that holds a large share of
    the rows is joined apart from the others; ``scans`` are the same tables before
    any work, where such keys are cheap to find.
    """
    need = needed_columns(spec)
    flat = lambda t: tables[t].select(*[F.col(c).alias(f"{t}__{c}") for c in need[t]])
    now = flat(spec.base)
    done = [spec.base]
    for j in spec.joins:
        owner = join_owner(spec, j.on, done)
        left = now.withColumn("_key", F.col(f"{owner}__{j.on}")).where(F.col("_key").isNotNull())
        right = flat(j.table).withColumn("_key", F.col(f"{j.table}__{j.on}"))
        probe = scans[owner].select(F.col(j.on).alias("_key")) if scans else None
        now = skewed_join(left, right, "_key", probe=probe).drop("_key")
        done.append(j.table)
    names = sorted(need, key=len, reverse=True)

    def bound(expression: str) -> str:
        for t in names:
            expression = expression.replace(f"{t}.", f"{t}__")
        return expression

    return now.select(*[F.expr(bound(c.expression)).alias(c.name) for c in spec.columns])


def physical(layer: str, *logical: str) -> str:
    """A stable physical name for a logical one."""
    return f"{layer}_{hashlib.sha256('.'.join(logical).encode()).hexdigest()[:8]}"


def name_map(specs: tuple[TableSpec, ...]) -> list[tuple[str, str, str, str, str, str]]:
    """(silver table, silver column, gold view, gold column, logical table, logical column) for every column; collisions are refused."""
    rows = []
    for s in specs:
        for c in s.columns:
            rows.append((physical("silver", s.name), physical("col", s.name, c.name), physical("gold", s.name), physical("fld", s.name, c.name), s.name, c.name))
    for k in (1, 3):
        if len({r[k] for r in rows}) != len(rows):
            raise ValueError("two columns have one physical name")
    return rows


def gold(df: DataFrame, names: dict[str, str], view: str | None = None) -> DataFrame:
    """A rename of every column; with ``view`` also registered as a view, which stays lazy."""
    out = df.select(*[F.col(c).alias(names[c]) for c in df.columns])
    if view:
        out.createOrReplaceTempView(view)
    return out


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that are in the map and keep all others."""
    return df.withColumnsRenamed(names)


def replace_table(df: DataFrame, name: str) -> None:
    """Drop and create as select."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
