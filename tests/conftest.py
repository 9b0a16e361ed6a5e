import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tests")):
    if path not in sys.path:
        sys.path.insert(0, path)


@pytest.fixture(scope="session")
def spark():
    from costweave.session import with_settings

    session = (with_settings(SparkSession.builder).master("local[8]").appName("costweave-tests")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.shuffle.partitions", "8")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session
