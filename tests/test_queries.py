"""Every query against its SQL on the smallest tables, and the entry module without the optional parts."""

import math
import subprocess
import sys

import duckdb
import pytest

from quillmine import queries, source_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.QUERIES | source_queries.QUERIES, queries.ORACLES | source_queries.ORACLES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or type(v).__name__ in ("NaTType", "NAType"):
        return None
    if hasattr(v, "isoformat"):
        return str(v).removesuffix(" 00:00:00")
    return v.item() if hasattr(v, "item") else v


def rows(df):
    columns = sorted(df.columns)
    return sorted([tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False)], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) == len(queries.QUERIES) + len(source_queries.QUERIES)


def test_entry_works_without_the_optional_subpackage(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("quillmine.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "q_search" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries()), list(e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
