import pytest

from cellgrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("cellgrid-tests", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
