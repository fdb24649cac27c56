import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lexiloom.session import local_session

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def _without_staged_tables():
    yield
    from pyspark.sql import SparkSession

    from lexiloom.stages import clear_staged

    if SparkSession.getActiveSession() is not None:
        clear_staged(SparkSession.getActiveSession())
