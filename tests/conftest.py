from __future__ import annotations

import pytest

from lorespan.session import local_session

SMALL = "/root/testdata/sf0.001"
# Column expressions of parametrized tests are built at import, which needs a session.
SPARK = local_session(8, app="tests")


@pytest.fixture(scope="session")
def spark():
    return SPARK


@pytest.fixture(scope="session")
def root() -> str:
    return SMALL
