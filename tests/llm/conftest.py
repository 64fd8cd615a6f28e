import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(autouse=True)
def _larger_splits(spark):
    """Workers find the package, and tables here are read in few splits; tests elsewhere keep their own setting."""
    from vigil.llm.queries import importable

    importable(spark)
    before = spark.conf.get(SPLITS)
    spark.conf.set(SPLITS, "1m")
    yield
    spark.conf.set(SPLITS, before)
