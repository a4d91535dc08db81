import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))  # for the workers
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluates a column on one row of named values."""

    def of(column, **row):
        names = list(row) or ["_"]
        kinds = ", ".join(f"{n} {'array<string>' if isinstance(row.get(n), list) else 'int' if isinstance(row.get(n), int) else 'string'}" for n in names)
        return spark.createDataFrame([tuple(row.get(n) for n in names)], kinds).select(column.alias("v")).first().v

    return of
