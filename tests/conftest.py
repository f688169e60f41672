import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from groundwork.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    cores = int(os.environ.get("GROUNDWORK_CORES", "8"))
    session = build_session("tests", master=f"local[{cores}]", cores=cores, **{"spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
