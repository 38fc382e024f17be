from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import local_session  # noqa: E402

RAW = (
    "event_time string, event_type string, product_id string, category_id string, category_code string, brand string, "
    "price string, user_id string, user_session string, src string"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    yield session
    session.stop()


@pytest.fixture
def make_raw(spark):
    """Raw events from (time, type, product, category, brand, price, user, session[, src]) rows."""

    def build(rows):
        full = [
            (r[0], r[1], r[2], "1", r[3], r[4], r[5], r[6], r[7], r[8] if len(r) > 8 else "a.csv") for r in rows
        ]
        return spark.createDataFrame(full, RAW)

    return build
