from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from wiretally.plans.detection import tune
    from wiretally.session import build_session

    s = build_session("wiretally-tests")
    s.sparkContext.setLogLevel("ERROR")
    tune(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
