import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session
    s = build_session("local[4]", shuffle_partitions=4, app="tidemark-tests")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
