import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from jobsift.session import get_session
    s = get_session("local[4]", app="jobsift-tests", shuffle_partitions=8)
    yield s
    s.stop()
