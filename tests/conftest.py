import datetime as dt

import pytest

from chronoraster.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4, spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def at():
    """Time so many seconds after 2018-01-01."""
    return lambda s: dt.datetime(2018, 1, 1) + dt.timedelta(seconds=s)
