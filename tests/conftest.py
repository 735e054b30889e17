"""One local session for all tests."""

import pytest

from tracequarry.session import local_session


@pytest.fixture(scope="session")
def spark():
    yield local_session("tests", cores=8, shuffle_partitions=8, memory="6g")
