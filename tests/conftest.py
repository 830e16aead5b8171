import os
import sys
from datetime import datetime, timedelta

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from brewlens.session import build_session  # noqa: E402

START = datetime(2026, 4, 20, 8, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "brewlens-tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def signal_rows(batch, variable, values, step_seconds=30, start=START, unit=None):
    return [
        (batch, start + timedelta(seconds=step_seconds * i), variable, float(v), unit) for i, v in enumerate(values)
    ]


def growth_curve(seed=42, lag=50):
    """Lag, exponential rise, plateau and decline."""
    r = np.random.default_rng(seed)
    return np.concatenate([
        np.full(lag, 0.1) + r.normal(0, 0.005, lag),
        np.linspace(0.1, 5.0, 100) + r.normal(0, 0.05, 100),
        np.full(80, 5.0) + r.normal(0, 0.1, 80),
        np.linspace(5.0, 3.0, 30) + r.normal(0, 0.05, 30),
    ])


TELEMETRY = "batch_id string, ts timestamp, variable string, value double, unit string"


@pytest.fixture
def telemetry(spark):
    def build(*parts):
        return spark.createDataFrame([row for part in parts for row in part], TELEMETRY)

    return build
