import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from plylake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", partitions=4)


@pytest.fixture()
def rows(spark):
    """Rows of a frame as sorted tuples of the named columns."""

    def get(df, *names):
        return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)

    return get
