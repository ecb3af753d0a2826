import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import geodesy, grid, normalise
from sightline.operators import aggregate, interest, segments
from sightline.settings import Settings

BASE = (-2.5879, 51.4545)


def test_neighbourhoods(spark):
    known = {0: 0, 3: 0, 60: 0, 63: 0, 4: 1, 44: 1, 19: 4, 79: 4, 80: 5, 83: 5, 383: 20, 399: 24, 400: 25}
    rows = spark.createDataFrame([(k,) for k in known], "i long").select("i", grid.neighbourhood_id(F.col("i"), 20, 16).alias("n"))
    assert {r["i"]: r["n"] for r in rows.collect()} == known


def test_best_of_neighbourhoods(spark):
    s = Settings(60)
    values = spark.range(400).select(F.col("id").alias("tvs_id"), F.col("id").alias("value")).withColumn("dem_id", grid.dem_id_of(F.col("tvs_id"), 60))
    best = {r["neighbourhood_id"]: r["dem_id"] for r in aggregate.best_in_neighbourhoods(values, s, 16, "value").collect()}
    assert (best[80], best[81], best[143], best[144]) == (1403, 1407, 2375, 2379)
    assert 79 not in best and 145 not in best
    level = aggregate.best_in_neighbourhoods(values.withColumn("value", F.lit(1)), s, 16, "value").collect()
    assert {r["neighbourhood_id"]: r["dem_id"] for r in level}[80] == 1220


def test_segments_pack_and_unpack(spark):
    rows = spark.createDataFrame([(0, 3), (65535, 65535), (7, 0)], "s int, d int")
    packed = rows.withColumn("p", segments.pack(F.col("s"), F.col("d")))
    assert [(r[0], r[1]) for r in packed.select(segments.unpack_start(F.col("p")), segments.unpack_distance(F.col("p"))).collect()] == [(0, 3), (65535, 65535), (7, 0)]
    blob = packed.agg(F.collect_list("p").alias("p")).select("p", segments.to_blob(F.col("p")).alias("b")).withColumn("back", segments.from_blob(F.col("b"))).first()
    assert blob["p"] == blob["back"] and bytes(blob["b"]) == bytes.fromhex("00000003ffffffff00070000")
    for bad in ([(65536, 0)], [(0, 65536)]):
        with pytest.raises(Exception, match="16 bits"):
            spark.createDataFrame(bad, "s int, d int").select(segments.pack(F.col("s"), F.col("d"))).collect()
    with pytest.raises(Exception, match="cut off"):
        spark.sql("select unhex('000000') as b").select(segments.from_blob(F.col("b"))).collect()


def test_lines_pack_and_unpack(spark):
    s = Settings(12)
    rows = spark.createDataFrame([(123, 45), (4194303, 1023)], "d int, a int").withColumn("p", aggregate.pack_line(F.col("d"), F.col("a"), s))
    assert [tuple(r) for r in rows.select(aggregate.unpack_distance(F.col("p")), aggregate.unpack_angle(F.col("p"))).collect()] == [(123, 45), (4194303, 1023)]
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([(4194304, 0)], "d int, a int").select(aggregate.pack_line(F.col("d"), F.col("a"), s)).collect()
    with pytest.raises(ValueError):
        aggregate.pack_line(F.lit(1), F.lit(1), Settings(12, subdivisions=3))


def test_runs(spark):
    def runs(bits):
        rows = spark.createDataFrame([(1, 0, k, b == "T") for k, b in enumerate(bits, 1)], "dem_id long, angle_id int, k int, visible boolean")
        return [(r["start"], r["distance"]) for r in segments.polar_segments(rows).orderBy("start").collect()]

    assert runs("TTTFT") == [(0, 3), (4, 1)]
    assert runs("TFF") == [(0, 1)]
    assert runs("TFTTTTF") == [(0, 1), (2, 4)]
    assert runs("FTT") == [(0, 0), (1, 2)]


def test_normalisers(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 120.2, 40.9, 91.0])], "i int, value double")
    got = {m: [r["normal"] for r in normalise.normalise(rows, m).orderBy("i").collect()] for m in normalise.METHODS}
    assert got["welford"] == pytest.approx([0.0, 0.9719484, 0.30667996, 0.726982], abs=1e-6)
    assert got["unit"] == pytest.approx([0, 1, 39.9 / 119.2, 90 / 119.2])
    assert got["exponential"][1] == 1
    level = spark.createDataFrame([(0, 5.0), (1, 5.0)], "i int, value double")
    assert {r["normal"] for r in normalise.unit(level).collect()} == {0.0}
    assert [r[0] for r in spark.sql("select explode(array(-1d, 0.5d, 2d, double('NaN'))) as n").select(normalise.pixel(F.col("n"))).collect()] == [0, 127, 255, 0]


def test_projection_there_and_back():
    x, y = geodesy.forward(np.array([-2.573510680530247, BASE[0]]), np.array([51.463487311585936, BASE[1]]), *BASE)
    assert [x[0], y[0], x[1], y[1]] == pytest.approx([1000, 1000, 0, 0], abs=1e-6)
    draw = np.random.default_rng(1)
    east, north = draw.uniform(-5e5, 5e5, (2, 300))
    back = geodesy.forward(*geodesy.inverse(east, north, *BASE), *BASE)
    assert np.abs(back[0] - east).max() < 1e-5 and np.abs(back[1] - north).max() < 1e-5


def test_coordinates_are_parsed():
    assert geodesy.parse_lonlat(" -2.5, 51.25") == (-2.5, 51.25)
    for bad in ("1", "1,2,3", "a,b"):
        with pytest.raises(ValueError):
            geodesy.parse_lonlat(bad)


def test_area_of_interest(spark):
    from sightline.api import aoi_polygon

    s = Settings(300, scale=100.0, centre=(-3.1791, 51.4816))
    box = aoi_polygon([(-3.2511, 51.4366), (-3.1071, 51.4366), (-3.1071, 51.5266), (-3.2511, 51.5266)], s)
    kept = {r[0] for r in spark.createDataFrame([(0,), (45150,)], "i long").where(interest.inside(F.col("i"), 300, box)).collect()}
    assert kept == {45150}
    square = [(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0)]
    inner = {r["id"] for r in spark.range(36).where(interest.inside(F.col("id"), 6, square)).collect()}
    assert inner == {14, 15, 20, 21}
    assert spark.range(36).where(interest.inside(F.col("id"), 6, [])).count() == 36


def test_rings(spark):
    rows = spark.createDataFrame([(1, 45, 1, 1)], "dem_id long, angle_id int, start int, distance int")
    ring = segments.rings(rows, 360, 1.0).first()["ring"]
    expected = [(4.7009093, 3.2867496), (4.7132504, 3.2990907), (5.4265009, 2.5981815), (5.4018185, 2.5734991)]
    got = {(round(p["x"] + 4, 5), round(4 - p["y"], 5)) for p in ring}
    assert got == {(round(x, 5), round(y, 5)) for x, y in expected} and ring[0] == ring[-1]


def test_points_and_ids_from_coordinates(spark):
    # A point a kilometre east and north of the base.
    lon, lat = -2.573510680530247, 51.463487311585936
    row = spark.range(1).select(
        geodesy.to_metres(F.lit(lon), F.lit(lat), *BASE).alias("m"), geodesy.to_degrees(F.lit(1000.0), F.lit(1000.0), *BASE).alias("d"),
        geodesy.lonlat_to_dem_id(F.lit(lon), F.lit(lat), 60, 100.0, BASE).alias("id"), geodesy.metres_per_degree(F.lit(60.0)).alias("long"),
        geodesy.dem_id_to_lonlat(F.lit(60 * 20 + 40), 60, 100.0, BASE).alias("back"),
        *[c.alias(n) for c, n in zip(geodesy.grid_position(F.lit(1000.0), F.lit(1000.0), 60, 100.0), ("column", "row"), strict=True)],
        grid.nearest_cell(F.lit(2.5), F.lit(1.4), 12).alias("cell"), *[c.alias(n) for c, n in zip(grid.turned(F.lit(2.0), F.lit(1.0), 90.0), ("tx", "ty"), strict=True)],
    ).first()
    assert (row["m"]["x"], row["m"]["y"]) == pytest.approx((1000, 1000), abs=1e-6)
    assert (row["d"]["lon"], row["d"]["lat"]) == pytest.approx((lon, lat), abs=1e-12)
    assert (row["column"], row["row"]) == pytest.approx((39.5, 19.5))
    assert row["id"] == 20 * 60 + 40 and row["cell"] == 12 + 3
    assert row["long"] == pytest.approx(111319.49079 / 2, rel=1e-9)
    x, y = geodesy.forward(np.array([row["back"]["lon"]]), np.array([row["back"]["lat"]]), *BASE)
    assert (x[0], y[0]) == pytest.approx((950, 1050), abs=1e-6)
    assert (row["tx"], row["ty"]) == pytest.approx((-1, 2))


def test_anchors_may_differ_by_row(spark):
    rows = spark.createDataFrame([(10.0, -20.0, 5.0, 50.0), (10.0, -20.0, -70.0, -30.0)], "x double, y double, lon0 double, lat0 double")
    there = rows.withColumn("d", geodesy.to_degrees(F.col("x"), F.col("y"), F.col("lon0"), F.col("lat0")))
    back = there.select("lon0", "d", geodesy.to_metres(F.col("d.lon"), F.col("d.lat"), F.col("lon0"), F.col("lat0")).alias("m")).collect()
    assert all((r["m"]["x"], r["m"]["y"]) == pytest.approx((10, -20), abs=1e-6) and abs(r["d"]["lon"] - r["lon0"]) < 0.01 for r in back)


def test_moving_the_anchor():
    x, y = geodesy.reanchored(np.array([0.0, 500.0]), np.array([0.0, 0.0]), BASE, BASE)
    assert np.abs(x - [0, 500]).max() < 1e-6 and np.abs(y).max() < 1e-6
    lon, lat = geodesy.inverse(np.array([1000.0]), np.array([1000.0]), *BASE)
    x, y = geodesy.reanchored(np.array([1000.0]), np.array([1000.0]), BASE, (lon[0], lat[0]))
    assert abs(x[0]) < 1e-6 and abs(y[0]) < 1e-6


def test_projection_strings():
    assert geodesy.projection_strings(-2.5, 51.0) == ("+proj=latlong +datum=WGS84", "+proj=aeqd +lat_0=51.0 +lon_0=-2.5 +units=m +datum=WGS84 +no_defs +over")
