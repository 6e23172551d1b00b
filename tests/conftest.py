import pytest

from cartulary.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
