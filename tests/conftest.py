import sys
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from tabwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def catalogue(spark):
    """Bicycles with the body heights they fit; the last one's load was never measured."""
    rows = [
        ("tern", "city", 14, 7, 150, 172, 110, "rent"), ("wren", "city", 18, 3, 158, 180, 125, "sale"),
        ("kite", "race", 7, 22, 165, 190, 95, "sale"), ("heron", "cargo", 31, 11, 155, 195, 220, "rent"),
        ("finch", "fold", 12, 3, 140, 168, 90, "gone"), ("owl", "cargo", 38, 1, 160, 200, None, "sale"),
    ]
    return spark.createDataFrame(
        rows, "bike string, kind string, weight long, gears long, shortest long, tallest long, load long, state string")


def sensor_rows(entities=6, readings=120, step=timedelta(minutes=30), seed=7, heavy=None):
    """Irregular series with nulls and repeated times; ``heavy`` multiplies the rows of the first entity."""
    rng = np.random.default_rng(seed)
    start, rows = datetime(2024, 1, 1), []
    for e in range(entities):
        n = readings * (heavy if heavy and e == 0 else 1)
        gap = step / (heavy if heavy and e == 0 else 1)
        for i in range(n):
            jitter = timedelta(seconds=int(rng.integers(0, 600)) if rng.random() > 0.2 else 0)
            again = rows and rows[-1][0] == f"m{e}" and rng.random() < 0.08
            time = rows[-1][1] if again else start + gap * i + jitter
            value = None if rng.random() < 0.05 else float(np.round(rng.normal(50 + e, 10), 3))
            rows.append((f"m{e}", time, ("a", "b", "c")[int(rng.integers(0, 3))], value,
                         int(rng.random() < 0.03), len(rows)))
    return rows


SENSOR_SCHEMA = "machine_id string, timestamp timestamp_ntz, kind string, value double, failure int, row_id long"


@pytest.fixture(scope="session")
def sensors(spark):
    return spark.createDataFrame(sensor_rows(), SENSOR_SCHEMA).cache()


@pytest.fixture(scope="session")
def skewed(spark):
    """The first entity holds more than a third of the rows."""
    return spark.createDataFrame(sensor_rows(entities=5, readings=80, heavy=6), SENSOR_SCHEMA).cache()
