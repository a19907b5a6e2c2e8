from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tillweave.session import build_session

    session = build_session(
        "tests", "local[4]",
        **{
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables here")
    return SF_DIR


@pytest.fixture(scope="session")
def extract(spark):
    """Extracts receipts from a dict of texts in one job; returns rows by file name."""
    from tillweave.operators.receipts import extract_receipts

    def run(texts: dict[str, str], **rules):
        raw = spark.createDataFrame(list(texts.items()), "filename string, raw_text string")
        return {r.filename: r for r in extract_receipts(raw, **rules).collect()}

    return run


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
