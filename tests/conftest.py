import os
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from frontgauge.session import LIMITS, build_session  # noqa: E402

SMALL = {"window.rows": 90, "compare.rows": 70, "broadcast.rows": 40, "site.rows": 16, "sweep.rows": 70}


@pytest.fixture(scope="session")
def spark():
    s = build_session(os.environ.get("TEST_CPUS", "8"), "tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "3")
    yield s
    s.stop()


@pytest.fixture(params=["roomy", "tight"])
def room(request, spark):
    """Run a test twice: with ordinary limits, and with groups too big for one task."""
    if request.param == "tight":
        for k, v in SMALL.items():
            spark.conf.set(f"frontgauge.{k}", str(v))
    yield request.param
    for k in LIMITS:
        spark.conf.unset(k)


@pytest.fixture(scope="session")
def cloud():
    """One group holds most rows; values repeat, and one vector is copied often."""
    rng = np.random.default_rng(3)
    n = 300
    pdf = pd.DataFrame(
        {
            "g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.25, 0.05]),
            "id": np.arange(n),
            "f1": rng.integers(0, 25, n).astype(float),
            "f2": rng.integers(0, 25, n).astype(float),
            "f3": rng.integers(0, 25, n).astype(float),
            "f4": rng.integers(0, 25, n).astype(float),
        }
    )
    copies = rng.choice(n, 80, replace=False)
    pdf.loc[copies, ["g", "f1", "f2", "f3", "f4"]] = ["a", 3.0, 2.0, 4.0, 5.0]
    return pdf
