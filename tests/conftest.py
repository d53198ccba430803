import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from churnkit.session import local_session, shared_dir

    s = local_session("*", shuffle_partitions=8, app="churnkit-tests")
    shared_dir(s)  # a private checkpoint folder when the session has none
    yield s
    s.stop()
