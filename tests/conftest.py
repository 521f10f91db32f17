"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from textloom.session import session

    s = session("local[8]", 8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
