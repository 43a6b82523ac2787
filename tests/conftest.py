"""One small Spark session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from impactframe.session import local_session, release, ship  # noqa: E402

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("impactframe-tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    release(session)


@pytest.fixture(scope="session")
def small():
    path = f"{TESTDATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("test tables are not here")
    return path
