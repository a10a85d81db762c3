import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from namemine.session import local_session

    s = local_session(cores="4", shuffle_partitions=8, app="namemine-tests")
    yield s
    s.stop()


SMOKE_DIR = "/root/testdata/sf0.001"
