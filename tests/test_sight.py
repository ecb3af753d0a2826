"""Visibility against known values, and the two paths against each other."""

import pytest
from pyspark.sql import functions as F

from sightline.functions.rotation import rotated_cells
from sightline.operators import aggregate, kernel, segments, sight
from sightline.settings import NODATA, Settings
from sightline.sources.dem import grid_from_values

N = NODATA
# Fixed test grid: a summit, a hole beside it and a corner without data.
HILL = [
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1,
    0, 1, 1, 1, 1, 1, 1, 1, 0, 1, 0, 0,
    0, 1, 3, 3, 2, 2, 2, 3, 4, 3, 0, 0,
    0, 1, 3, 4, 3, 3, 3, 3, 3, 2, 1, 0,
    0, 1, 3, 4, 5, 5, 5, 4, 3, 2, 1, 0,
    0, 1, 3, 4, 4, 0, 6, 5, 4, 2, 1, 0,
    0, 1, 1, 2, 5, 9, 15, 7, 5, 2, 1, 0,
    0, 1, 1, 4, 4, 4, 4, 6, 3, 2, 1, 0,
    0, 0, 3, 4, 4, 4, 5, 4, N, N, N, N,
    0, 3, 3, 4, 3, 2, 3, 3, N, N, N, N,
    0, 0, 3, 4, 2, 2, 1, 2, N, N, N, N,
    3, 0, 2, 3, 1, 0, 1, 0, N, N, N, N,
]
POVS = (65, 66, 77, 78)


def small(**kw):
    return Settings(12, **({"observer_height": 0.8} | kw))


@pytest.fixture(scope="module")
def hill(spark):
    return grid_from_values(spark, HILL).cache()


def sums(rows, settings):
    return {r["dem_id"]: r["sum_k"] * settings.scale * 0.0174533 for r in rows.collect()}


@pytest.mark.parametrize(
    ("kw", "expected"),
    [
        ({}, (6.283163, 21.118624, 47.909348, 62.832096)),
        ({"refraction": 0.0}, (6.283163, 21.118624, 47.909348, 62.832096)),
        ({"refraction": -12756274.0}, (6.283163, 9.424768, 14.468756, 38.083088)),
        ({"scale": 0.01}, (0.06283202, 0.21118537, 0.4790932, 0.6283214)),
        ({"scale": 100.0}, (628.317, 2111.8528, 4790.9106, 6283.1714)),
    ],
)
def test_surfaces(hill, kw, expected):
    s = small(**kw)
    for rows in (kernel.surfaces(hill, s), aggregate.total_surfaces(sight.visibility(hill, s))):
        got = sums(rows, s)
        assert set(got) == set(POVS)
        assert [got[d] for d in POVS] == pytest.approx(expected, rel=1e-5)


def test_surfaces_of_two_angles(hill):
    got = sums(kernel.surfaces(hill, small(), [0, 180]), small())
    assert [got[d] for d in POVS] == pytest.approx((0.0349066, 0.1570797, 0.19198631, 0.34906602), rel=1e-5)


def test_longest_lines(hill):
    expected = {65: (1, 0), 66: (4, 29), 77: (4, 1), 78: (4, 0)}
    for rows in (kernel.surfaces(hill, small()), aggregate.longest_lines(sight.visibility(hill, small()))):
        assert {r["dem_id"]: (r["longest_k"], r["longest_angle"]) for r in rows.collect()} == expected


def test_segments_on_both_paths(hill):
    one = kernel.segments(hill, small()).cache()
    two = segments.polar_segments(sight.visibility(hill, small()))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert {r["dem_id"]: r["count"] for r in one.groupBy("dem_id").count().collect()} == {65: 360, 66: 428, 77: 375, 78: 360}


def test_other_cells_are_zero(hill):
    dense = aggregate.dense(kernel.surfaces(hill, small()), small(), ["sum_k"]).collect()
    assert len(dense) == 16 and {r["tvs_id"] for r in dense if r["sum_k"]} == {5, 6, 9, 10}


def test_lines_of_a_numbered_grid(spark):
    s = Settings(6)
    rows = rotated_cells(spark, s, [0, 45, 90]).collect()
    lines = {(a, y): [r["dem_id"] for r in sorted((r for r in rows if (r["angle_id"], r["line"]) == (a, y)), key=lambda r: r["pos"])] for a in (0, 45, 90) for y in (0, 1)}
    assert lines == {
        (0, 0): [14, 15, 16, 17], (0, 1): [20, 21, 22, 23], (45, 0): [20, 14, 10, 4], (45, 1): [21, 15, 16, 11], (90, 0): [20, 14, 8, 2], (90, 1): [21, 15, 9, 3],
    }


@pytest.mark.parametrize(("width", "observers"), [(12, 4), (24, 32), (36, 88), (48, 172)])
def test_every_observer_appears_once_at_each_angle(spark, width, observers):
    from sightline.functions.grid import is_computable

    seen = rotated_cells(spark, Settings(width)).where(F.col("pos") < width // 3).where(is_computable(F.col("dem_id"), width))
    per_angle = seen.groupBy("angle_id").agg(F.count("*").alias("n"), F.countDistinct("dem_id").alias("d")).select("n", "d").distinct().collect()
    assert per_angle == [(observers, observers)]


def test_no_data_takes_the_height_before_it(spark):
    flat = [5] * 36
    flat[14] = flat[15] = NODATA
    flat[20] = 7
    got = sight.lines(grid_from_values(spark, flat), Settings(6), [0]).orderBy("line", "pos").collect()
    assert [r["elev"] for r in got] == [0, 0, 5, 5, 7, 5, 5, 5]


@pytest.mark.parametrize("bad", [{"width": 10}, {"width": 12, "subdivisions": 101}, {"width": 12, "neighbourhood": 8}, {"width": 12, "scale": 0.0}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


@pytest.mark.parametrize("seed", range(4))
def test_both_paths_agree_on_random_grids(spark, seed, monkeypatch):
    import random

    draw = random.Random(seed)
    width = draw.choice([9, 15, 24])
    heights = [draw.choice([N, draw.randint(-50, 400)]) if draw.random() < 0.1 else draw.randint(0, 60) for _ in range(width * width)]
    s = Settings(width, scale=draw.choice([1.0, 30.0]), refraction=draw.choice([0.13, -1e5]), subdivisions=draw.choice([1, 2]))
    angles = sorted(draw.sample(range(s.angles), 40))
    dem = grid_from_values(spark, heights).cache()
    seen = sight.visibility(dem, s, angles).cache()
    if seed % 2:
        monkeypatch.setattr(kernel, "GRID_BYTES", 0)  # the way of grids too large to send
    made, wanted = kernel.segments(dem, s, angles), segments.polar_segments(seen)
    assert made.exceptAll(wanted).isEmpty() and wanted.exceptAll(made).isEmpty()
    sums = kernel.surfaces(dem, s, angles).select("dem_id", "sum_k", "longest_k", "longest_angle")
    best = seen.where("visible").groupBy("dem_id").agg(F.sum("k").alias("sum_k"))
    expected = best.join(aggregate.longest_lines(seen), "dem_id").select("dem_id", "sum_k", "longest_k", "longest_angle")
    got, want = ({r["dem_id"]: tuple(r)[1:] for r in rows.collect()} for rows in (sums.where("sum_k > 0"), expected))
    assert got == want
    some = dem.where("dem_id % 3 = 0").select("dem_id")
    assert {r["dem_id"]: tuple(r)[1:] for r in kernel.surfaces(dem, s, angles, some).where("sum_k > 0").collect()} == {k: v for k, v in want.items() if k % 3 == 0}


def test_a_neighbourhood_must_fit():
    with pytest.raises(ValueError):
        Settings(12, neighbourhood=25)
