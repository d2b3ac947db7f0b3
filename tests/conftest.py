import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seekspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]", "tests",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """evaluate(rows, ddl, column) -> values of the column in row order."""

    def run(rows, ddl, column):
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_i int, " + ddl)
        return [r.v for r in frame.select("_i", column.alias("v")).orderBy("_i").collect()]

    return run
