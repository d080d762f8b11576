import pytest

from leafmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
