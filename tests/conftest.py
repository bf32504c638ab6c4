from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from saleslode.session import local_session

    session = local_session("tests", "8", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def layout(spark):
    from saleslode.session import scratch_path
    from saleslode.settings import Layout

    base = scratch_path(spark, "test")
    return Layout(f"{base}/data", f"{base}/models")
