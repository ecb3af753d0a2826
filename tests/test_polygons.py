import json
import math
import random

import pytest

from sightline.operators import polygons as p
from sightline.operators.segments import area
from sightline.settings import Settings
from sightline.sources.ascii import bresenham, raster


@pytest.fixture(scope="module")
def built(spark):
    def made(lists):
        views = spark.createDataFrame([(1, [[(s, n) for s, n in runs] for runs in lists])], "dem_id long, angles array<array<struct<start:int,distance:int>>>")
        rows = p.polygons_of_arrays(views, len(lists)).orderBy("polygon_id").collect()
        return [{"exterior": [tuple(c) for c in r["exterior"]], "interiors": [[tuple(c) for c in h] for h in r["interiors"]]} for r in rows]

    return made


@pytest.mark.parametrize(
    ("lists", "holes"),
    [
        ([[(0, 5)]] * 3, [0]),
        ([[(2, 2)]] * 10, [1]),
        ([[(1, 1), (3, 1)]] * 10, [1, 1]),
        ([[(0, 4)], [(0, 4)], [(2, 1)], [(0, 4)], [(0, 4)]], [1]),
        ([[], [(2, 2)], [(0, 1), (2, 2)], [(0, 5)], []], [0]),
        ([[(0, 2)], [(2, 2)], [], [], [], []], [0, 0]),
        ([[(0, 2)], [], [(0, 2)], [], [], []], [0, 0]),
        ([[]] * 5, []),
    ],
)
def test_shapes(built, lists, holes):
    made = built(lists)
    assert [len(x["interiors"]) for x in made] == holes
    for x in made:
        assert all(r[0] == r[-1] for r in [x["exterior"], *x["interiors"]])


@pytest.mark.parametrize("seed", range(12))
def test_polygons_have_the_area_of_their_segments_and_are_the_components(spark, built, seed):
    draw = random.Random(seed)
    n = draw.choice([12, 24, 36])
    lists = []
    for _ in range(n):
        at, runs = 0, []
        while at < 10:
            start, size = at + draw.randint(0, 3), draw.randint(1, 4)
            runs.append((start, size))
            at = start + size + 1
        lists.append(runs[: draw.randint(0, 3)])
    made = built(lists)
    got = sum(abs(p.signed_area(x["exterior"][:-1])) - sum(abs(p.signed_area(h[:-1])) for h in x["interiors"]) for x in made)
    want = sum(((s + d) ** 2 - s**2) / 2 * math.sin(2 * math.pi / n) for runs in lists for s, d in runs)
    assert got == pytest.approx(want)
    rows = [(1, a, s, d) for a, runs in enumerate(lists) for s, d in runs]
    if rows:
        frame = spark.createDataFrame(rows, "dem_id long, angle_id int, start int, distance int")
        assert p.component_counts(frame, n).first()["components"] == len(made)


def test_viewshed_rows(spark):
    rows = spark.createDataFrame([(7, a, 0, 4) for a in range(360)] + [(8, 0, 0, 2)], "dem_id long, angle_id int, start int, distance int")
    got = {r["dem_id"]: r for r in p.viewshed_polygons(rows, Settings(12, scale=10.0)).collect()}
    assert got[7]["area"] == pytest.approx(math.pi * 1600, rel=1e-4)
    assert {r["dem_id"]: r["ring_sum"] for r in area(rows, 360, 10.0).collect()} == {7: 360 * 16, 8: 4}


def test_geojson_is_a_multipolygon(spark):
    rows = spark.createDataFrame([(65, a, 2, 2) for a in range(360)], "dem_id long, angle_id int, start int, distance int")
    s = Settings(12, scale=1000.0, centre=(-2.5, 51.4))
    text = json.loads(p.geojson_rows(p.in_degrees(p.viewshed_polygons(rows, s), s)).first()["geojson"])
    (shape,) = text["features"]
    assert all(abs(x + 2.5) < 0.1 and abs(y - 51.4) < 0.1 for ring in shape["geometry"]["coordinates"][0] for x, y in ring)
    assert shape["geometry"]["type"] == "MultiPolygon" and len(shape["geometry"]["coordinates"][0]) == 2


def test_raster_of_a_ring(built):
    art = raster(built([[(2, 2)]] * 60), 16, 4.0)
    assert len(art) == 8 and art[4][8] == " " and art[4][1] != " " and art[0][0] == " "


def test_line_raster():
    assert list(bresenham((0, 0), (3, 1))) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert list(bresenham((2, 2), (2, 0))) == [(2, 2), (2, 1), (2, 0)]


def test_packed_arrays_and_flat_rings(spark):
    runs = [[(0, 4)], [(0, 4)], [(2, 1)], [(0, 4)], [(0, 4)]]
    packed = spark.createDataFrame([(1, [[s << 16 | n for s, n in r] for r in runs])], "dem_id long, angles array<array<long>>")
    plain = spark.createDataFrame([(1, runs)], "dem_id long, angles array<array<struct<start:int,distance:int>>>")
    one, two = (p.polygons_of_arrays(v, 5) for v in (packed, plain))
    assert one.collect() == two.collect()
    flat, whole = p.flattened_rings(two).first(), two.first()
    assert flat["exterior"] == [v for c in whole["exterior"] for v in c]
    assert flat["interiors"] == [v for h in whole["interiors"] for c in h for v in c] and flat["hole_indices"] == [0]
    twice = p.flattened_rings(two.selectExpr("dem_id", "polygon_id", "exterior", "concat(interiors, interiors) as interiors")).first()
    assert twice["hole_indices"] == [0, len(flat["interiors"])]


def test_ring_problems(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    assert p.ring_problems(square) == [] and p.ring_problems(square[::-1], hole=True) == []
    assert p.ring_problems(square, hole=True) == p.ring_problems(square[::-1]) == ["wrong direction"]
    assert p.ring_problems([]) == ["empty"]
    assert p.ring_problems(square[:-1]) == ["not closed"]
    assert p.ring_problems(square[:2] + square[:1]) == ["too few corners"]
    assert "repeated corner" in p.ring_problems([square[0], *square])
    assert "edges cross" in p.ring_problems([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 1.0), (0.0, 0.0)])
    assert p.ring_problems([(float("nan"), 0.0)] * 5) == ["not finite"]
    # Two triangles that touch in a corner are one sound ring.
    assert "edges cross" not in p.ring_problems([(0.0, 0.0), (1.0, -1.0), (1.0, 1.0), (0.0, 0.0), (-1.0, 1.0), (-1.0, -1.0), (0.0, 0.0)])
    rows = spark.createDataFrame([(7, 0, square[::-1], [square])], f"dem_id long, polygon_id int, exterior {p.RING}, interiors array<{p.RING}>")
    assert [(r["ring"], r["problem"]) for r in p.invalid_rings(rows).collect()] == [(0, "wrong direction"), (1, "wrong direction")]
