"""A Spark data source for JSON lists served over HTTP, and a sink that posts rows there."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

TIMEOUT_S = 10


class _Page(InputPartition):
    def __init__(self, url: str) -> None:
        super().__init__(url)
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.urls = [options["base"].rstrip("/") + "/" + p.strip("/") for p in options["paths"].split(",")]
        self.names = names

    def partitions(self) -> list[_Page]:
        return [_Page(u) for u in self.urls]

    def read(self, partition: _Page) -> Iterator[tuple]:
        with urllib.request.urlopen(partition.url, timeout=TIMEOUT_S) as r:  # noqa: S310
            body = json.load(r)
        for row in body.get("value", body) if isinstance(body, dict) else body:
            yield tuple(partition.url if n == "_url" else (v if isinstance(v := row.get(n), str | None) else json.dumps(v)) for n in self.names)


class _Posted(WriterCommitMessage):
    pass


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.url, self.size, self.names = options["url"], int(options.get("batch", "500")), names

    def write(self, iterator) -> WriterCommitMessage:
        rows: list[dict] = []
        for r in iterator:
            rows.append(dict(zip(self.names, r, strict=True)))
            if len(rows) >= self.size:
                self._post(rows)
                rows = []
        if rows:
            self._post(rows)
        return _Posted()

    def _post(self, rows: list[dict]) -> None:
        request = urllib.request.Request(self.url, data=json.dumps({"rows": rows}, default=str).encode(), headers={"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as r:  # noqa: S310
            if r.status >= 400:
                raise OSError(f"{self.url}: {r.status}")

    def commit(self, messages) -> None:
        return None

    def abort(self, messages) -> None:
        return None


class RestLists(DataSource):
    """``spark.read.format("rest_lists").schema(...).option("base", ...).option("paths", "a,b").load()``: one partition per path.

    Each path serves a JSON list, or an object with one under ``value``.  Columns
    are text; ``_url`` is the address a row came from.  Written rows are posted in
    batches as {"rows": [...]} to the option ``url``.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_lists"

    def schema(self) -> str:
        return "id string, name string, _url string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema.names)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema.names)


MOST_PARENTS = 10_000


def listed(spark: SparkSession, base: str, paths: list[str], schema: str) -> DataFrame:
    spark.dataSource.register(RestLists)
    return spark.read.format("rest_lists").schema(schema).option("base", base).option("paths", ",".join(paths)).load()


def children(spark: SparkSession, base: str, parents: DataFrame, pattern: str, schema: str, key: str = "id") -> DataFrame:
    """What hangs below each parent: ``pattern`` with the parent's key for ``{}`` is its path; the key comes out as ``parent_id``.

    All paths are read by one scan, one partition each.  The number of parents, a
    catalog's artifacts, is checked.
    """
    keys = [r[0] for r in parents.select(F.col(key).cast("string")).where(F.col(key).isNotNull()).distinct().limit(MOST_PARENTS + 1).collect()]
    if len(keys) > MOST_PARENTS:
        raise ValueError(f"more than {MOST_PARENTS} parents")
    names = f"parent_id string, {schema}"
    if not keys:
        return spark.createDataFrame([], names)
    at = spark.createDataFrame([(base.rstrip("/") + "/" + pattern.format(k).strip("/"), k) for k in keys], "_url string, parent_id string")
    rows = listed(spark, base, [pattern.format(k) for k in keys], f"{schema}, _url string")
    return rows.join(at, "_url").drop("_url").select("parent_id", *[c.split()[0] for c in schema.split(", ")])


def discovered(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The artifacts of the first group that a server lists: reports, dashboards and datasets, with tiles, tables and refreshes below them."""
    group = listed(spark, base, ["groups"], "id string, name string").first()
    if group is None:
        raise LookupError(f"{base} lists no group")
    at = f"groups/{group['id']}"
    found = {k: listed(spark, base, [f"{at}/{k}"], "id string, name string") for k in ("reports", "dashboards", "datasets")}
    found["tiles"] = children(spark, base, found["dashboards"], at + "/dashboards/{}/tiles", "id string, title string, reportId string, datasetId string")
    found["tables"] = children(spark, base, found["datasets"], at + "/datasets/{}/tables", "name string, columns string")
    found["refreshes"] = children(spark, base, found["datasets"], "datasets/{}/refreshes", "requestId string, status string, startTime string")
    return found


def pushed(tables: dict[str, DataFrame]) -> dict[str, str]:
    """Post each table to its address, in order: ``ok`` or the error.  A refusal by the server leaves the others to go on; without a connection the rest is not tried."""
    out: dict[str, str] = {}
    for url, df in tables.items():
        df.sparkSession.dataSource.register(RestLists)
        try:
            df.write.format("rest_lists").option("url", url).mode("append").save()
            out[url] = "ok"
        except Exception as e:  # noqa: BLE001 - the error is the result
            text = str(e)
            out[url] = "refused" if "HTTPError" in text else "no connection" if "URLError" in text or "Connection" in text else text[:300]
            if out[url] == "no connection":
                break
    return out
