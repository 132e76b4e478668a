import os

import pytest

from webloom.session import local_session

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("8", 8)


@pytest.fixture(scope="session")
def sf():
    return DATA
