import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from semshift.session import build_session

    s = build_session("local[4]", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
