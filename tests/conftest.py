import pytest

from gneiss.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]", memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    return s
