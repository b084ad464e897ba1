from __future__ import annotations

import pytest

from lorespan.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, app="tests")


@pytest.fixture(scope="session")
def root() -> str:
    return SMALL


def groups(n: int, edges) -> dict:
    """Component of each of n nodes, named by its smallest, by plain search."""
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in range(n)}
