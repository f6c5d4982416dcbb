import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", "")
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ['PYTHONPATH']}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from foliant.session import local_session

    session = local_session(4, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
