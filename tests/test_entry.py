"""The contract: names, coverage, and SQL against Spark at the smallest size where the data is there."""

import ast
import glob
import os

import pytest

import __spark_entry__ as E
from loomlake.plans import catalog_oracle, data_oracle, data_queries, reference_oracle, reference_queries

DATA = "/root/testdata/sf0.001"


def test_core_does_not_need_the_llm_package():
    root = os.path.dirname(os.path.abspath(E.__file__))
    for path in glob.glob(f"{root}/loomlake/**/*.py", recursive=True):
        if "/llm/" in path:
            continue
        for node in ast.walk(ast.parse(open(path).read())):
            if isinstance(node, ast.ImportFrom):
                assert "llm" not in (node.module or ""), path
            if isinstance(node, ast.Import):
                assert all("llm" not in a.name for a in node.names), path


def test_names():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {"p2_found", "p7_found", "p4_rolling_totals"} <= set(q)
    assert len(reference_queries.QUERIES) >= 70


CORE = [n for n in [*reference_queries.QUERIES, *data_queries.QUERIES] if n in reference_oracle.ORACLE | catalog_oracle.ORACLE | data_oracle.ORACLE]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_sql_agrees(spark):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    text = lambda rows: sorted(tuple("null" if v is None or v != v else str(v) for v in r) for r in rows)
    wrong = []
    for name in CORE:
        df = E.queries()[name](spark, DATA)
        cols = sorted(df.columns)
        rel = c.sql(E.oracle_sql()[name])
        if cols != sorted(rel.columns):
            wrong.append((name, "columns"))
            continue
        got = text(tuple(r) for r in df.select(*cols).collect())
        want = text(rel.select(*[f'"{x}"' for x in cols]).fetchall())
        if got != want:
            wrong.append((name, len(got), len(want), [x for x in got if x not in want][:2], [x for x in want if x not in got][:2]))
    assert not wrong
