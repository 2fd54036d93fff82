import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from flowsift.session import build_session
    s = build_session("local[4]", shuffle_partitions=8, app="flowsift-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from check_oracle import duck
    return duck(SF_SMALL)
