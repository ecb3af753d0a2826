"""Viewsheds of the test grid from end to end, against drawings of their outlines."""

import pytest

from sightline import api
from sightline.operators import kernel, polygons
from sightline.settings import Settings
from sightline.sources import ascii
from sightline.sources.dem import grid_from_values

from .test_sight import HILL

# Outlines of known viewsheds, two points to a cell.
SUMMIT = [
    "████████████████████████",
    "████████████████████████",
    "███████▀▀ ▄▄▄▄▄ ▀▀██████",
    "█████▀ ▄█████████▄ ▀████",
    "████▀ █████████████ ▀███",
    "████ ███████████████ ███",
    "████ ███████████████ ███",
    "████ ▀█████████████▀ ███",
    "█████ ▀███████████▀ ████",
    "██████▄ ▀▀█████▀▀ ▄█████",
    "█████████▄▄▄▄▄▄▄████████",
    "████████████████████████",
]
NEAR_SUMMIT = [
    "████████████████████████",
    "████████████████████████",
    "█████▀▀ ▄▄▄▄▄ ▀▀████████",
    "███▀ ▄█████████▄ ▀██████",
    "██▀ █████████████ ▀█████",
    "██ ███████████████ █████",
    "██ ████████▀ ▄▄▄▄▄▄█████",
    "██ ▀█▀▄ ██ ▄████████████",
    "███ ▀▄▄███ █████████████",
    "████▄ ▀▀██ █████████████",
    "███████▄▄▄▄█████████████",
    "████████████████████████",
]
HOLE = [
    "████████████████████████",
    "████████████████████████",
    "████████████████████████",
    "████████████████████████",
    "████████▀ ▄ ▀███████████",
    "████████ ▀█▀ ███████████",
    "█████████▄▄▄████████████",
    "████████████████████████",
    "████████████████████████",
    "████████████████████████",
    "████████████████████████",
    "████████████████████████",
]
TALL = [
    "████████████████████████",
    "█████▀▀ ▄▄▄▄▄ ▀▀████████",
    "███▀ ▄█████████▄ ▀██████",
    "██▀ █████████████ ▀█████",
    "██ ███████████████ █████",
    "██ ███████████████ █████",
    "██ ▀█████████████▀ █████",
    "███ ▀███████████▀ ██████",
    "████▄ ▀▀█████▀▀ ▄███████",
    "███████▄▄▄▄▄▄▄██████████",
    "████████████████████████",
    "████████████████████████",
]


def drawn(spark, dem_id, **kw):
    settings = Settings(12, **({"observer_height": 0.8, "centre": (33.33, 33.33)} | kw))
    one = spark.createDataFrame([(dem_id,)], "dem_id long")
    found = kernel.segments(grid_from_values(spark, HILL), settings, observers=one)
    shapes = [{"exterior": [tuple(c) for c in r["exterior"]], "interiors": [[tuple(c) for c in h] for h in r["interiors"]]} for r in polygons.viewshed_polygons(found, settings).collect()]
    return ascii.outlines(shapes, 12, (dem_id % 12, dem_id // 12))


@pytest.mark.parametrize(
    ("dem_id", "kw", "expected"),
    [(78, {}, SUMMIT), (77, {}, NEAR_SUMMIT), (77, {"subdivisions": 4}, NEAR_SUMMIT), (65, {}, HOLE), (65, {"observer_height": 20.0}, TALL)],
)
def test_outlines(spark, dem_id, kw, expected):
    assert "\n".join(drawn(spark, dem_id, **kw)) == "\n".join(expected)


def test_the_best_of_a_neighbourhood_stands_for_all_of_it(spark, tmp_path):
    from sightline.operators.aggregate import dense, surface
    from sightline.plans.metadata import settings_of
    from sightline.operators.segments import decoded, lookup
    from sightline.functions.grid import neighbourhood_id
    from pyspark.sql import functions as F

    settings = Settings(12, observer_height=0.8, centre=(33.33, 33.33), neighbourhood=16)
    dem = grid_from_values(spark, HILL)
    heat = dense(kernel.surfaces(dem, settings), settings, ["sum_k"]).select("tvs_id", surface(F.col("sum_k"), settings).alias("value"))
    api.compute(dem, settings, process="viewsheds", segments_path=str(tmp_path), best_source=heat)
    rows, kept = spark.read.parquet(f"{tmp_path}/polar_segments"), settings_of(spark.read.parquet(f"{tmp_path}/metadata"))
    assert kept.neighbourhood == 16 and {r["dem_id"] for r in rows.where("neighbourhood_id = 4").select("dem_id").distinct().collect()} == {78}
    for dem_id in (65, 78, 91):
        near = spark.range(1).select(neighbourhood_id(F.lit(dem_id), 12, 16)).first()[0]
        shapes = polygons.viewshed_polygons(decoded(lookup(rows, neighbourhood_id=near)), kept).collect()
        shapes = [{"exterior": [tuple(c) for c in r["exterior"]], "interiors": [[tuple(c) for c in h] for h in r["interiors"]]} for r in shapes]
        assert ascii.outlines(shapes, 12, (6, 6)) == SUMMIT
