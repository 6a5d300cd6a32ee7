import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from quillspan.session import local_session, ship

    s = local_session("*", 4, "6g")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
