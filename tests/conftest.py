import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from contactmill.session import local_session

    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def empty_tables(spark):
    from contactmill.sources.tables import SCHEMAS, Tables, struct_of

    return Tables(**{n: spark.createDataFrame([], struct_of(d)) for n, d in SCHEMAS.items()})
