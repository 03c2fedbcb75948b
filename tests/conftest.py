import pathlib
import sys

import pytest

ROOT = str(pathlib.Path(__file__).resolve().parent.parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tidewell.session import local_session

    s = local_session(4, app="tests", driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
