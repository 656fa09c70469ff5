"""Column statistics from Parquet footers and dictionaries.

The unit is the chunk: one column in one row group of one file.  Footers give
its exact row and null counts, where written, and its extrema where the format
makes them valid (not for floating point, where a NaN voids them, and not for
texts that a writer may have cut).  The dictionary of a chunk gives its distinct
values.  Only the chunks whose footer is not enough are read, each once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.session import ship

FILES_PER_TASK = 4
#: Some writers cut long texts in statistics: extrema of this length or more are not taken.
CUT_LENGTH = 60


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """The data files below ``path``, a few per task."""
    ship(spark)
    files = sorted(spark.read.parquet(path).inputFiles())
    tasks = max(1, -(-len(files) // FILES_PER_TASK))
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks)


def _open(uri: str, dictionaries: list[str] | None = None):
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    where, path = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(where.open_input_file(path), read_dictionary=dictionaries)


_FACTS = "file string, row_group int, column_name string, kind string, rows long, nulls long, lo string, hi string, lo_n long, hi_n long, load long"


def chunk_facts(spark: SparkSession, path: str, columns: list[str], load: str | None = None) -> DataFrame:
    """One row per chunk, from the footers alone: what they are valid for.

    ``kind`` is text, whole, float or other; ``nulls`` is null where it was not
    written, ``lo`` and ``hi`` (texts) or ``lo_n`` and ``hi_n`` (whole numbers) where the
    extrema are not valid.  ``load`` is the row group's one value of the load column,
    null where it holds several.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for uri in b["file"]:
                with _open(uri) as f:
                    at = {f.metadata.schema.column(j).path: j for j in range(f.metadata.num_columns)}
                    types = {c: f.schema_arrow.field(c).type for c in columns}
                    for g in range(f.metadata.num_row_groups):
                        meta = f.metadata.row_group(g)
                        s = meta.column(at[load]).statistics if load else None
                        one = int(s.min) if s is not None and s.has_min_max and s.has_null_count and s.null_count == 0 and s.min == s.max else None
                        for c in columns:
                            s, t = meta.column(at[c]).statistics, types[c]
                            kind = "text" if pa.types.is_string(t) or pa.types.is_large_string(t) else "whole" if pa.types.is_integer(t) else "float" if pa.types.is_floating(t) else "other"
                            lo = hi = lo_n = hi_n = None
                            if s is not None and s.has_min_max and kind == "whole":
                                lo_n, hi_n = int(s.min), int(s.max)
                            elif s is not None and s.has_min_max and kind == "text" and max(len(s.min), len(s.max)) < CUT_LENGTH:
                                lo, hi = s.min, s.max
                            rows.append((uri, g, c, kind, meta.num_rows, s.null_count if s is not None and s.has_null_count else None, lo, hi, lo_n, hi_n, one))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in _FACTS.split(", ")])
            yield out.astype({c: "Int64" for c in ("nulls", "lo_n", "hi_n", "load")})

    return file_list(spark, path).mapInPandas(work, _FACTS)


def spread(chunks: DataFrame) -> DataFrame:
    """Chunks over all cores: each is a read of its own."""
    return chunks.repartition(max(chunks.sparkSession.sparkContext.defaultParallelism, chunks.rdd.getNumPartitions()))


def load_nulls(spark: SparkSession, path: str, load: str, columns: list[str]) -> DataFrame:
    """(load_id, column_name, rows, nulls), summed over all row groups.

    A row group that holds one load (equal extrema of the load column, without
    nulls) is answered by its footer; of any other, the load column and the
    nulls of the wanted columns are read.  ``from_footer`` counts the rows answered without reading.
    """
    facts = chunk_facts(spark, path, columns, load)
    known = facts.where("load is not null and nulls is not null").select(F.col("load").cast("int").alias("load_id"), "column_name", "rows", "nulls", F.col("rows").alias("from_footer"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for uri, g, c in zip(b["file"], b["row_group"], b["column_name"], strict=True):
                with _open(uri) as f:
                    t = f.read_row_group(int(g), columns=[load, c])
                part = pa.table({"l": t.column(load), "x": pc.cast(pc.is_null(t.column(c)), pa.int64())}).group_by("l").aggregate([("x", "count"), ("x", "sum")])
                rows += [(k, c, n, z, 0) for k, n, z in zip(part.column("l").to_pylist(), part.column("x_count").to_pylist(), part.column("x_sum").to_pylist(), strict=True)]
            yield pd.DataFrame(rows, columns=["load_id", "column_name", "rows", "nulls", "from_footer"]).astype({"load_id": "Int32", "rows": "int64", "nulls": "int64", "from_footer": "int64"})

    open_ = spread(facts.where("load is null or nulls is null").select("file", "row_group", "column_name"))
    raw = known.unionByName(open_.mapInPandas(read, "load_id int, column_name string, rows long, nulls long, from_footer long"))
    return raw.groupBy("load_id", "column_name").agg(*[F.sum(c).alias(c) for c in ("rows", "nulls", "from_footer")])


def coded_counts(spark: SparkSession, path: str, load: str, column: str) -> DataFrame:
    """(load_id, value, n) of a text column without its nulls: each chunk's dictionary is decoded once and its places are counted, never its texts.

    A chunk that is not written with a dictionary gets one as it is read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with _open(uri, [column]) as f:
                    t = f.read_row_group(g, columns=[load, column]).unify_dictionaries()
                for part in t.combine_chunks().to_batches():
                    loads, coded = part.column(0).to_pandas(), part.column(1)
                    codes = coded.indices.to_pandas()
                    counts = pd.DataFrame({"l": loads, "c": codes})[codes.notna()].groupby(["l", "c"], dropna=False).size().reset_index(name="n")
                    load_ids = pa.array(counts["l"].astype("Int32"), pa.int32())
                    yield pa.RecordBatch.from_arrays([load_ids, pc.cast(coded.dictionary.take(pa.array(counts["c"].astype("int64"))), pa.string()), pa.array(counts["n"], pa.int64())], names=["load_id", "value", "n"])

    groups = spread(chunk_facts(spark, path, [column]).where("rows > 0").select("file", "row_group"))
    return groups.mapInArrow(work, "load_id int, value string, n long").groupBy("load_id", "value").agg(F.sum("n").alias("n"))


_READ = "column_name string, chunk boolean, nulls long, lo string, hi string, lo_n long, hi_n long, lo_f double, hi_f double, value string"


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk one row with extrema (of finite numbers), and the nulls where they were not known, and one row for each of its different values."""
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}
    shape = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _READ.split(", "))])
    for b in batches:
        for r in b.to_pylist():
            c, kind = r["column_name"], r["kind"]
            with _open(r["file"], [c] if kind == "text" else None) as f:
                col = f.read_row_group(r["row_group"], columns=[c]).column(0)
            if pa.types.is_dictionary(col.type):
                found = pc.unique(pa.chunked_array([k.dictionary for k in col.chunks], col.type.value_type)).drop_null()
            else:
                found = pc.unique(col).drop_null()
            if kind == "float":
                found = pc.unique(pc.add(pc.cast(found, pa.float64()), 0.0))  # one zero
            usable = found.filter(pc.is_finite(found)) if kind == "float" else found
            ends = pc.min_max(usable).as_py() if len(usable) else {"min": None, "max": None}
            end = "_n" if kind == "whole" else "_f" if kind == "float" else ""
            head = {"column_name": c, "chunk": True, "nulls": None if r["known"] else col.null_count}
            head |= {f"{n}{end}": v if v is None or end else str(v) for n, v in (("lo", ends["min"]), ("hi", ends["max"]))}
            yield pa.RecordBatch.from_pylist([head], shape)
            values = found if kind == "text" else pc.cast(found, pa.string())
            empty = {n: pa.nulls(len(found), t) for n, t in zip(shape.names, shape.types, strict=True)}
            full = empty | {"column_name": pa.array([c] * len(found), pa.string()), "value": pc.cast(values, pa.string())}
            yield pa.RecordBatch.from_arrays(list(full.values()), schema=shape)


def insufficient(facts: DataFrame, distinct: bool) -> DataFrame:
    """The chunks that must be read: without a valid null count or extrema, or all that have values where distinct values are asked for."""
    some = F.col("nulls").isNull() | (F.col("nulls") < F.col("rows"))
    blind = F.col("nulls").isNull() | some & F.col("lo").isNull() & F.col("lo_n").isNull()
    wanted = facts.where((F.col("rows") > 0) & (blind | some if distinct else blind))
    return wanted.select("file", "row_group", "column_name", "kind", F.col("nulls").isNotNull().alias("known"))


def column_profile(spark: SparkSession, path: str, columns: list[str], distinct: bool = True) -> DataFrame:
    """Per column: rows, nulls, distinct values (exact), least and greatest value as text.

    Footers answer rows, nulls and extrema wherever they are valid; distinct values
    come from the dictionaries of text chunks and from scans of the others.  With
    ``distinct=False`` a table whose footers are valid is profiled without reading
    any data.  ``chunks`` and ``chunks_read`` tell how many chunks there are and how
    many were read.  Extrema of floating-point columns are of finite values.  Distinct
    counts ignore nulls; a column of nulls only has 0 and null extrema.
    """
    types = dict(spark.read.parquet(path).dtypes)
    facts = chunk_facts(spark, path, columns)
    read = spread(insufficient(facts, distinct)).mapInArrow(_read_chunks, _READ)
    least = [F.min(c).alias(c) for c in ("lo", "lo_n", "lo_f")] + [F.max(c).alias(c) for c in ("hi", "hi_n", "hi_f")]
    seen = read.groupBy("column_name").agg(*least, F.count("chunk").alias("chunks_read"), F.sum("nulls").alias("r_nulls"), F.count_distinct("value").alias("n_distinct"))
    counted = facts.groupBy("column_name").agg(F.sum("rows").alias("n_rows"), F.count("*").alias("chunks"), F.min("lo").alias("f_lo"), F.max("hi").alias("f_hi"), F.min("lo_n").alias("f_lo_n"), F.max("hi_n").alias("f_hi_n"), F.sum("nulls").alias("f_nulls"))
    every = spark.createDataFrame([(c, types[c]) for c in columns], "column_name string, data_type string")
    j = every.join(counted, "column_name", "left").join(seen, "column_name", "left")
    text = lambda a: F.coalesce(
        F.least(f"f_{a}", a) if a == "lo" else F.greatest(f"f_{a}", a),
        (F.least(f"f_{a}_n", f"{a}_n") if a == "lo" else F.greatest(f"f_{a}_n", f"{a}_n")).cast("string"),
        F.col(f"{a}_f").cast("string"),
    )
    j = j.withColumn("n_nulls", F.coalesce("f_nulls", F.lit(0)) + F.coalesce("r_nulls", F.lit(0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return j.select("column_name", zero("n_rows"), zero("n_nulls"), zero("n_distinct"), text("lo").alias("lo"), text("hi").alias("hi"), zero("chunks"), zero("chunks_read"))
