import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from tidegauge.session import local_session  # noqa: E402

DATA = Path(os.environ.get("TIDEGAUGE_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tidegauge-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA / "sf0.01")
