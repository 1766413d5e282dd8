import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from durata.session import get_session
    s = get_session("local[4]", shuffle_partitions=8, app="durata-tests",
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="durata-test-ckpt-")})
    yield s
    s.stop()
