"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest
from conftest import SF

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_point  # noqa: E402

from pairwright.plans.oracles import ORACLES  # noqa: E402
from pairwright.plans.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def normal(value):
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def table(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) == 84
    assert QUERIES.items() <= entry_point.queries().items()
    assert ORACLES.items() <= entry_point.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    got = table(df.columns, df.collect())
    assert got
    assert got == table(names, result.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).columns == [
        "doc_id", "item_id", "hits", "n_key_terms", "keyword_coverage"
    ]


@pytest.mark.parametrize("absent", ["pairwright.llm", "corpus_pipeline", "public_tokenizers", "tokenizers"])
def test_the_entry_point_lives_without_the_optional_part(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; print(len(e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(out.stdout) >= len(QUERIES)
