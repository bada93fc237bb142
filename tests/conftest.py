import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casegrid.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="casegrid-tests")
    # Tests run locally: give them their own shared folder if none is set.
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="casegrid-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path(spark):
    from casegrid.session import scratch_path
    return scratch_path(spark, "test")
