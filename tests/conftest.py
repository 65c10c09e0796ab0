import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from memlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("memlake-tests", cpus="8", memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def rows(df, *cols):
    out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(out, key=str)
