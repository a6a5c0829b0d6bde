import pytest

from leafloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=2)
    s.sparkContext.setLogLevel("ERROR")
    yield s
