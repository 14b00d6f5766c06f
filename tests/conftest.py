import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from autotab.session import build_session
    s = build_session("local[4]", shuffle_partitions=4)
    # tests own the checkpoint folder (on a cluster it comes from spark.checkpoint.dir)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="autotab-test-ckpt-"))
    yield s
