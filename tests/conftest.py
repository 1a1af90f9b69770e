import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from arborlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column_values(spark):
    """Evaluate an expression over literal rows: ``column_values(schema, rows, expression)``."""

    def evaluate(schema, rows, *expressions):
        frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "_n int, " + schema)
        found = frame.select("_n", *expressions).orderBy("_n").collect()
        return [r[1] if len(expressions) == 1 else tuple(r[1:]) for r in found]

    return evaluate
