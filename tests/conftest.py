import pytest

from inkmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus="8", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
