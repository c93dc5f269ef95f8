import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from snapcase.session import build_session  # noqa: E402
from snapcase.sources.snapshots import SNAPSHOT_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", 8, app_name="snapcase-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="snapcase-test-")})
    yield s
    s.stop()


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def snap(spark, rows):
    """Snapshot rows as tuples in SNAPSHOT_SCHEMA order; date strings allowed."""
    fixed = []
    for r in rows:
        r = list(r)
        for i in (1, 2):
            if isinstance(r[i], str):
                r[i] = ts(r[i] if " " in r[i] else r[i] + " 00:00:00")
        fixed.append(tuple(r))
    return spark.createDataFrame(fixed, SNAPSHOT_SCHEMA)


def row(bn, bd, sd, age=30, g="M", race="R1", ms="Single", grp="G", charge="C",
        cat="FELONY", disp=None):
    return (bn, bd, sd, age, g, race, ms, grp, charge, cat, disp)
