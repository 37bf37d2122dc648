import pytest

from gapwise.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def folder():
    return SMALL
