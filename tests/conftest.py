from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from faultline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g", app="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def seconds(base: str, offset: float):
    from datetime import datetime, timedelta

    return datetime.fromisoformat(base) + timedelta(seconds=offset)
