"""Every registered query against its SQL oracle on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, connect  # noqa: E402

from daygrid.plans.catalog import REGISTRY  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, duck, name):
    state, rows, note = compare(spark, duck, name, FOLDER)
    assert state in ("ok", "rows only"), note
    assert rows > 0 or name in ("column_check",)


def test_every_survey_row_is_covered():
    """Operators that have a table result must have a registered query."""
    covered = {c for e in REGISTRY.values() for c in e.covers}
    wanted = (
        [f"S{i}" for i in range(1, 10)] + [f"P{i}" for i in range(1, 17)] + [f"F{i}" for i in range(1, 17)]
        + [f"V{i}" for i in range(1, 13)] + [f"J{i}" for i in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11)] + ["J7a", "J7b"]
        + [f"A{i}" for i in range(1, 25)] + [f"W{i}" for i in range(1, 10)] + [f"K{i}" for i in range(1, 5)]
        + [f"U{i}" for i in range(1, 5)] + ["T1s"] + [f"T{i}" for i in range(2, 13)] + [f"M{i}" for i in range(1, 16)]
        + [f"E{i}" for i in range(1, 12)] + [f"C{i}" for i in range(1, 7)]
    )
    assert [w for w in wanted if w not in covered] == []
