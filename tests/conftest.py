import pytest

from tracewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(2, "2g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
