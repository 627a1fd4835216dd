import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from tidewire.plans.session import local_session

    return local_session(4, 4, "4g")


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"
