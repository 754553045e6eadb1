import pytest

from factloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[2]", 2, "1g")
    yield s
    s.stop()
