from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crosstally.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "crosstally-tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def orders(spark):
    return spark.createDataFrame(
        [
            ("A-07", "2025-02-10", "Store", 12.5),
            ("A-11", "2025-02-10", "Phone", 80.0),
            ("A-15", "2025-02-12", "Store", 40.0),
            ("A-19", "2025-02-13", "Phone", 7.5),
            ("A-19", "2025-02-13", "Phone", 7.5),
        ],
        "order_id string, order_date string, channel string, amount double",
    )


@pytest.fixture(scope="session")
def payments(spark):
    return spark.createDataFrame(
        [
            ("R1", "A-07", "2025-02-11", "Store", 12.5),
            ("R2", "A-11", "2025-02-14", "Phone", 75.0),
            ("R3", "A-15", "2025-02-12", "Store", 40.0),
            ("R4", "A-90", "2025-02-15", "Catalogue", 60.0),
            ("R5", "A-91", "2025-02-18", "Phone", 20.0),
            ("R6", "A-92", "2025-02-19", "Phone", 20.0),
        ],
        "payment_id string, order_id string, payment_date string, channel string, amount double",
    )


@pytest.fixture(scope="session")
def frame(spark):
    """``frame("id long, v double", (1, 2.0), ...)``"""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)
