import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE.parent), str(HERE)]

from session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture
def shared(tmp_path):
    return str(tmp_path)
