import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("BENCH_DRIVER_MEM", "4g")


@pytest.fixture(scope="session")
def spark():
    from lodestone.plans.session import build_session, ship

    s = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4"})
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
