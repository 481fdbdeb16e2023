import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faturalens.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "6g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_facts(spark):
    def make(rows):
        """Rows of (year, month, client, collaborator, amount)."""
        raw = "year int, month int, client string, collaborator string, amount string"
        return spark.createDataFrame(rows, raw).withColumn("amount", F.col("amount").cast("decimal(18,4)"))

    return make


@pytest.fixture(scope="session")
def facts(make_facts):
    return make_facts(
        [
            (2025, 1, "Alfa", "Ana", "100"),
            (2025, 2, "Beta", "Bia", "120"),
            (2025, 2, "Beta", None, None),
            (2025, 4, "Alfa", "Ana", "110"),
            (2026, 1, "Gama", "Bia", "150"),
            (None, 1, "Alfa", "Caio", "7"),
            (2026, None, None, "Ana", "3.5"),
            (2026, 2, "Nula", "Dora", None),
        ]
    )


def rows(df):
    return [tuple(r) for r in df.collect()]
