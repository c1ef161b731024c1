import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from strike_analytics.session import local_session
    s = local_session("*", app="strike_tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture()
def make_frames(spark):
    """Frames DataFrame from payloads (str -> UTF-8 bytes, bytes as given)."""
    from strike_analytics.schemas import FRAMES

    def build(payloads, session_id=0):
        rows = []
        for i, p in enumerate(payloads):
            b = p.encode("utf-8") if isinstance(p, str) else p
            rows.append((i, session_id, i + 1, dt.datetime(2024, 1, 1, 0, 0, i % 60), False, bytearray(b)))
        return spark.createDataFrame(rows, FRAMES)
    return build
