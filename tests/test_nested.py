"""Points stored once for all samples that hold them."""

import random

from pyspark.sql import functions as F

from stratapoint.config import Bounds, IndexConfig
from stratapoint.operators import load
from stratapoint.sources.scratch import stored
from stratapoint.sources.tiles import TileStore

POINTS = "file_index int, point_index long, mx double, my double, z double, classification int"


def test_a_nested_store_reads_as_one_of_samples_and_full_points(spark, tmp_path):
    rng, bounds = random.Random(3), Bounds(0, 0, 300, 200)
    points = spark.createDataFrame([(0, i, rng.uniform(0, 300), rng.uniform(0, 200), 1.0, 1) for i in range(400)], POINTS)
    index = load.build_index(points, "quadtree", bounds, IndexConfig(tile_sample_points=50), ("utm", 32628, 28, True, "label"), stored)
    apart, nested = TileStore(spark, str(tmp_path / "apart")), TileStore(spark, str(tmp_path / "nested"))
    samples = stored(index.samples, "samples")
    apart.save(index.tiles, samples.withColumn("kind", F.lit("sample")).unionByName(index.full.withColumn("kind", F.lit("full"))))
    nested.save(index.tiles, index.points)
    (own,) = nested.snapshot()[1]
    assert spark.read.parquet(f"{nested.path}/data/{own.name}/points").count() == 400  # each once
    first = {}
    for r in samples.collect():
        first.setdefault(r.tile_id, set()).add(r.point_index)
    assert len(first["0:r"]) == 50 and all(len(v) <= 50 for v in first.values())
    rows = lambda df: sorted(map(str, df.select("tile_id", "file_index", "kind", "depth", "point_index", "mx", "my", "z", "classification").collect()))
    assert rows(nested.points()) == rows(apart.points())
    leaf = index.full.first().tile_id
    for tile, kind in (("0:r", "sample"), (leaf, "sample"), (leaf, "full"), ("0:r", "full")):
        assert rows(nested.get(tile, kind)) == rows(apart.get(tile, kind))
    wanted = stored(spark.createDataFrame([("0:r", "sample"), (leaf, "sample"), (leaf, "full"), ("7:r", "full"), ("0:r.1", "sample")], "id string, source string"), "wanted")
    assert rows(nested.get_many(wanted)) == rows(apart.get_many(wanted))
