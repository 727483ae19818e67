import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rankfold.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=4, extra_conf={"spark.ui.showConsoleProgress": "false"})
    yield s


@pytest.fixture(scope="session")
def small_dir():
    return SMALL
