from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gneiss.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest driver tables; tests that need them are skipped elsewhere."""
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("driver tables are not here")
    return path


def rows(df, *columns):
    names = columns or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
