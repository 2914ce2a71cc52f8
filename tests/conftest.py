import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from vigia.session import checkpoint_dir, get_session

    os.environ.setdefault("VIGIA_SCRATCH", tempfile.mkdtemp(prefix="vigia-tests-"))
    s = get_session("local[*]", 8, extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
