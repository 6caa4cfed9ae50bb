import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lurelens.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="lurelens-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="lurelens-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf001():
    return SF001
