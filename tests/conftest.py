import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wardspark.session import get_session
    s = get_session("local[*]", 8, local_checkpoint_root=tempfile.mkdtemp(prefix="wardspark-test-"))
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
