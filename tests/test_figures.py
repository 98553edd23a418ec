"""What many cameras see of a tree, by counts alone and by the pairs of the descent."""

import pytest
from pyspark.sql import functions as F

from stratapoint.operators import selection
from stratapoint.plans import cloud
from stratapoint.plans.queries import quad
from stratapoint.sources.scratch import stored


@pytest.mark.parametrize("accumulate", [False, True])
def test_figures_are_those_of_the_descent(spark, sf, monkeypatch, accumulate):
    tiles = quad(spark, sf)
    cameras = cloud.camera_events(spark, sf).limit(60).union(cloud.camera_events(spark, sf).limit(1).withColumns({"camera_id": F.lit(-1).cast("long"), "lng": F.lit(None).cast("double")}))
    cameras = stored(cameras, "cameras")
    got = sorted(selection.figures(tiles, cameras, cloud.LOD, accumulate, stored).collect())
    monkeypatch.setattr(selection, "SENT_ROWS", 0)
    assert len(got) == 61 and got == sorted(selection.figures(tiles, cameras, cloud.LOD, accumulate, stored).collect())
