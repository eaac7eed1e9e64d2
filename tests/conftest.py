import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from foldspan.session import local_session

    return local_session("tests", cpus="4", partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
