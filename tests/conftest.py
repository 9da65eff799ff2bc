import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tastegrid.session import get_session
    conf = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    s = get_session("tests", 8, **conf)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def toy_ratings(spark):
    """40 users × 30 items; item 0 is rated by all, user 0 rates all: both are hot."""
    import numpy as np
    rng = np.random.default_rng(7)
    rows = [(u, i, int(rng.integers(1, 6))) for u in range(40) for i in range(30)
            if i == 0 or u == 0 or rng.random() < 0.2]
    return rows
