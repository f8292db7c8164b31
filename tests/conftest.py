import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hearthline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="hearthline-warehouse-"),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one Column function on literal rows."""
    from pyspark.sql import functions as F

    def run(fn, *rows, schema="x string"):
        frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
        out = frame.select(fn(*[F.col(n) for n in frame.columns]).alias("v")).collect()
        return [r.v for r in out]
    return run
