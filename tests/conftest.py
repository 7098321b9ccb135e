from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import get_session

    session = get_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__default__parallelism="4"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
