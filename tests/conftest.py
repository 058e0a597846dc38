import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from roamlens.session import get_session
    s = get_session("local[4]", app="roamlens-tests", shuffle_partitions=8)
    # tests run without a cluster, so the checkpoint folder is set here
    if not s.sparkContext.getCheckpointDir():
        d = tempfile.mkdtemp(prefix="roamlens-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)
