import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("THREADLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from threadloom.session import local_session

    session = local_session(4, 4)
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    yield session


@pytest.fixture(scope="session")
def data():
    return DATA
