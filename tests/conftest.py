from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from pairwright.plans.fixtures import ship_package

    ship_package(session)
    yield session
    session.stop()


def rows(df, *order):
    """Rows as tuples, ordered."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r)) if not order else out


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
