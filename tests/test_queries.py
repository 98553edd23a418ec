"""Every query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from compare import same_rows  # noqa: E402

from stratapoint.plans.registry import ORACLES, QUERIES, flagship  # noqa: E402

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    same_rows(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_flagship_has_active_tiles(spark, sf):
    out = flagship(spark, sf)
    assert out.columns == ["camera_id", "tile_id", "depth", "point_count", "angle"]
    assert out.limit(1).count() == 1


def test_class_budget_sums_to_the_budget():
    from stratapoint.operators.sampling import class_budgets

    assert class_budgets({1: 5, 2: 7}, 100) == {1: 5, 2: 7}
    assert class_budgets({1: 100, 2: 50, 3: 1}, 2).keys() == {2, 3}
    paid = class_budgets({1: 10_000, 2: 400, 3: 2}, 120)
    assert sum(paid.values()) == 120 and paid[3] <= 2 and paid[1] > paid[2] > paid[3]
