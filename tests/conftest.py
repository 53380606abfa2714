import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from facts import FACT_DDL  # noqa: E402
from factloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("factloom-tests", cores="4", shuffle_partitions=4, driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_facts(spark):
    def make(rows):
        return spark.createDataFrame(rows, FACT_DDL)

    return make
