"""Catalog discovery: table inventory, data dictionary, keys, relationships, ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.functions.expressions import dtype_label, singular, titled


def inventory(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, ordinal, data_type) from the schemas alone; nothing is read."""
    rows = [(t, c, i, dtype_label(k)) for t, df in tables.items() for i, (c, k) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string")


def like_tables(columns: DataFrame, pattern: str) -> DataFrame:
    """Tables whose names match an SQL pattern, letter case aside (``_`` stands for one character), sorted."""
    return columns.select("table_name").distinct().where(F.col("table_name").ilike(pattern)).orderBy("table_name")


def schemas(columns: DataFrame) -> DataFrame:
    """(table_name, n_columns, column_list) with the columns in order."""
    return columns.groupBy("table_name").agg(
        F.count("*").alias("n_columns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"]), ",").alias("column_list")
    )


def described(columns: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Descriptions of profiled columns: the given one, else the humanised name with what the profile says.

    ``columns`` is a profile with table_name; ``given`` has (table_name, column_name, description).
    """
    numeric = F.col("data_type").rlike("int|float")
    text = F.concat_ws(
        ". ",
        titled(F.col("column_name")),
        F.when(numeric & F.col("min_value").isNotNull(), F.concat(F.lit("Range: "), F.round("min_value", 2).cast("decimal(18,2)").cast("string"), F.lit("-"), F.round("max_value", 2).cast("decimal(18,2)").cast("string"))),
        F.when((F.col("n_rows") > 0) & (F.col("unique_count") == F.col("n_rows")), F.lit("Unique per row")).when(F.col("unique_count") > 0, F.concat(F.col("unique_count").cast("string"), F.lit(" distinct values"))),
        F.when(F.col("null_pct") > 0, F.concat(F.col("null_pct").cast("decimal(18,2)").cast("string"), F.lit("% null"))),
    )
    if given is None:
        return columns.withColumn("description", text)
    g = given.select("table_name", "column_name", F.col("description").alias("_given"))
    return columns.join(F.broadcast(g), ["table_name", "column_name"], "left").withColumn("description", F.coalesce(F.nullif("_given", F.lit("")), text)).drop("_given")


def originals(edges: DataFrame, gold: DataFrame) -> DataFrame:
    """(column_name, sources, expression, original_name): what each silver and gold column stands for.

    Sources are distinct and in order; the first expression counts; gold inherits silver.
    """
    base = edges.groupBy("target_column").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "source_column"))), lambda x: x["source_column"])).alias("sources"), F.min_by("expression", "ordinal").alias("expression")
    )
    named = base.select(F.col("target_column").alias("column_name"), "sources", "expression", F.element_at("sources", 1).alias("original_name"))
    inherited = gold.join(F.broadcast(named), gold["silver_column"] == named["column_name"]).select(F.col("gold_column").alias("column_name"), "sources", "expression", "original_name")
    return named.unionByName(inherited)


def dictionary(profiles: DataFrame, names: DataFrame, samples: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """The data dictionary: one row per column of every layer, with its original name, what the profile says, and its first values.

    ``profiles`` has (layer, table_name, column_name, ordinal) and profile columns,
    ``names`` is ``originals``; a column that is not in it is an original itself.
    ``given`` has descriptions of (table_name, column_name); others speak of the
    original name.
    """
    n = names.select("column_name", F.col("original_name").alias("_original"), F.col("sources").alias("_sources"), F.col("expression").alias("_expression"))
    j = profiles.join(n, "column_name", "left").withColumn("original_name", F.coalesce("_original", "column_name"))
    j = j.withColumn("source_columns", F.coalesce("_sources", F.array("column_name"))).withColumn("expression", F.coalesce("_expression", "column_name"))
    own = described(j.withColumn("_physical", F.col("column_name")).withColumn("column_name", F.col("original_name"))).withColumn("column_name", F.col("_physical"))
    if given is not None:
        g = given.select("table_name", "column_name", F.nullif("description", F.lit("")).alias("_given"))
        own = own.join(g, ["table_name", "column_name"], "left").withColumn("description", F.coalesce("_given", "description"))
    kept = ["layer", "table_name", "column_name", "ordinal", "original_name", "source_columns", "expression", "data_type", "description", "null_pct", "unique_count"]
    if samples is None:
        return own.select(*kept, F.array().cast("array<string>").alias("sample_values"))
    return own.join(samples, ["table_name", "column_name"], "left").select(*kept, F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"))


def carried(profiles: DataFrame, mapping: DataFrame) -> DataFrame:
    """Profiles of gold views: a view only renames, so its columns have the figures of the silver ones."""
    m = mapping.select(F.col("silver_table").alias("table_name"), F.col("silver_column").alias("column_name"), "gold_view", "gold_column")
    rest = [c for c in profiles.columns if c not in ("layer", "table_name", "column_name")]
    return profiles.where("layer = 'silver'").join(m, ["table_name", "column_name"]).select(F.lit("gold").alias("layer"), F.col("gold_view").alias("table_name"), F.col("gold_column").alias("column_name"), *rest)


def primary_keys(profiles: DataFrame) -> DataFrame:
    """(table_name, primary_key): the first unique column ending in _id, else <entity>_id or id, else the first column.

    ``profiles`` has table_name, column_name, ordinal, unique_count, n_rows.
    """
    entity = F.lower(singular(F.col("table_name")))
    rank = (
        F.when(F.col("column_name").endswith("_id") & (F.col("unique_count") == F.col("n_rows")), 1)
        .when((F.col("column_name") == F.concat(entity, F.lit("_id"))) | (F.col("column_name") == "id"), 2)
        .otherwise(F.when(F.col("ordinal") == 0, 3))
    )
    return profiles.withColumn("_k", rank).where("_k is not null").groupBy("table_name").agg(F.min(F.struct("_k", "ordinal", "column_name")).alias("b")).select("table_name", F.col("b.column_name").alias("primary_key"))


def relationships(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(parent, child, column_name): a column that two tables share and that is the key of one of them.

    Where it is the key of several, the last table by name is the parent, and the other key tables are no children.
    """
    marked = columns.join(F.broadcast(keys), "table_name").withColumn("is_key", F.col("column_name") == F.col("primary_key"))
    shared = marked.groupBy("column_name").agg(F.count("*").alias("n"), F.max(F.when(F.col("is_key"), F.col("table_name"))).alias("parent")).where("n >= 2 and parent is not null")
    return marked.where(~F.col("is_key")).join(F.broadcast(shared), "column_name").select("parent", F.col("table_name").alias("child"), "column_name")


def relationship_keys(links: DataFrame, lineage: DataFrame) -> DataFrame:
    """Each relationship with the silver columns of both sides; null unless both reach silver.

    Of several lineage rows of a bronze column the first counts.
    """
    first = lineage.withColumn("_r", F.row_number().over(Window.partitionBy("bronze_table", "bronze_column").orderBy("ordinal"))).where("_r = 1").select("bronze_table", "bronze_column", "silver_table", "silver_column", "gold_view", "gold_column")
    side = lambda s, t: first.select(
        F.col("bronze_table").alias(t), F.col("bronze_column").alias("column_name"), F.concat_ws(".", "silver_table", "silver_column").alias(f"{s}_silver"), F.concat_ws(".", "gold_view", "gold_column").alias(f"{s}_gold")
    )
    j = links.join(F.broadcast(side("from", "parent")), ["parent", "column_name"], "left").join(F.broadcast(side("to", "child")), ["child", "column_name"], "left")
    both = F.col("from_silver").isNotNull() & F.col("to_silver").isNotNull()
    return j.select(
        "parent", "child", "column_name", F.lit("one_to_many").alias("relationship_type"),
        F.when(both, F.col("from_silver")).alias("from_silver"), F.when(both, F.col("to_silver")).alias("to_silver"),
        F.when(both, F.col("from_gold")).alias("from_gold"), F.when(both, F.col("to_gold")).alias("to_gold"),
    )


MOST_NAMED = 10  # attributes that a description names


def entity_text(table: str, attributes: str) -> F.Column:
    """A description of an entity from its first attributes."""
    each = F.split(F.coalesce(F.col(attributes), F.lit("")), ", ")
    more = F.size(each) - MOST_NAMED
    named = F.concat(singular(F.col(table)), F.lit(" records with "), F.array_join(F.slice(each, 1, MOST_NAMED), ", "))
    return F.when(more > 0, F.concat(named, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(named)


def entities(columns: DataFrame, keys: DataFrame, lineage: DataFrame) -> DataFrame:
    """One row per raw table: name, source file, key, attributes without the key, and its silver table by the key's first lineage."""
    attributes = (
        columns.join(F.broadcast(keys), "table_name").where("column_name <> primary_key").groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"]), ", ").alias("attributes"))
    )
    first = lineage.withColumn("_r", F.row_number().over(Window.partitionBy("bronze_table", "bronze_column").orderBy("ordinal"))).where("_r = 1")
    reach = first.select(F.regexp_replace("bronze_table", "^(.*?)bronze_", "$1").alias("table_name"), F.col("bronze_column").alias("primary_key"), "silver_table", "gold_view")
    return keys.join(F.broadcast(attributes), "table_name", "left").join(F.broadcast(reach), ["table_name", "primary_key"], "left").select(
        singular(F.col("table_name")).alias("entity"), entity_text("table_name", "attributes").alias("description"), F.concat("table_name", F.lit(".csv")).alias("source_file"), "primary_key", F.coalesce("attributes", F.lit("")).alias("attributes"),
        F.coalesce("silver_table", F.lit("N/A")).alias("silver_table"), F.coalesce("gold_view", F.lit("N/A")).alias("gold_view"),
    )
