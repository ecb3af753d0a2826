"""The registered terrain queries and their oracles.

Each query grids all of lineitem into a square of elevations and runs one
operator over it. What could differ in the last bit between engines is
returned as integers, or rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, grid, normalise, rotation
from ..operators import aggregate, interest, kernel, polygons, segments, sight
from ..settings import Settings
from ..sources.tables import grid_from_lineitem
from . import oracle
from .metadata import metadata_row, read_metadata

#: Of the registered queries, the flagship and the benchmark.
PLAIN = Settings(48)
FLAGSHIP = Settings(36)
BENCH = Settings(144)
#: Angles of the short queries; each has a twin `_all_angles` over the whole circle.
FEW = [0, 45, 90, 180, 225, 315, 359]
BLOCK = 16
#: (column, row) corners of a rectangle inside the central third.
AREA = [(18.5, 17.5), (28.5, 17.5), (28.5, 27.5), (18.5, 27.5)]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def named(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return named


def flagship(spark: SparkSession, sf_dir: str, settings: Settings = FLAGSHIP) -> DataFrame:
    """Total surface and longest line of every observer, from one pass over the lines of sight."""
    dem = grid_from_lineitem(spark, sf_dir, settings.width)
    return kernel.surfaces(dem, settings).orderBy("dem_id")


def _dem(spark: SparkSession, sf_dir: str, settings: Settings = PLAIN) -> DataFrame:
    return grid_from_lineitem(spark, sf_dir, settings.width)


def _seen(spark: SparkSession, sf_dir: str, settings: Settings = PLAIN, angles: list[int] | None = None, **kw) -> DataFrame:
    return sight.visibility(_dem(spark, sf_dir, settings), settings, angles, **kw)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.segments(_dem(spark, sf_dir), PLAIN)


@register(oracle.query(oracle.dem(PLAIN), "select dem_id, elev from dem"))
def dem_grid(spark, sf_dir):
    return _dem(spark, sf_dir)


@register(oracle.query(oracle.dem(PLAIN), "select count(*) as n_cells, count(*) filter (elev = -32768) as n_nodata, min(elev) filter (elev <> -32768) as low, max(elev) as high from dem"))
def dem_nodata_stats(spark, sf_dir):
    known = F.when(F.col("elev") != -32768, F.col("elev"))
    return _dem(spark, sf_dir).agg(
        F.count("*").alias("n_cells"), F.count_if(F.col("elev") == -32768).alias("n_nodata"), F.min(known).alias("low"), F.max("elev").alias("high")
    )


@register(oracle.query(oracle.angles(PLAIN), "select angle_id, inverse, quadrant, round(alpha, 9) + 0.0::double as alpha, round(beta, 9) + 0.0::double as beta from angles"))
def angle_table(spark, sf_dir):
    return rotation.angle_table(spark, PLAIN).withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("alpha", "beta")})


@register(oracle.query(oracle.rotated(PLAIN, FEW), "select angle_id, line, pos, dem_id from rotated"))
def rotated_cells(spark, sf_dir):
    return rotation.rotated_cells(spark, PLAIN, FEW)


@register(oracle.query(oracle.lines(PLAIN, FEW), "select angle_id, line, pos, dem_id, coalesce(elev, -32768) as elev from gathered"))
def line_elevations(spark, sf_dir):
    cells = sight.gather(rotation.rotated_cells(spark, PLAIN, FEW), _dem(spark, sf_dir), PLAIN)
    return cells.select("angle_id", "line", "pos", "dem_id", F.coalesce("elev", F.lit(-32768)).alias("elev"))


@register(oracle.query(oracle.lines(PLAIN, FEW), "select angle_id, line, pos, dem_id, elev from lines"))
def line_filled(spark, sf_dir):
    return sight.lines(_dem(spark, sf_dir), PLAIN, FEW).select("angle_id", "line", "pos", "dem_id", "elev")


@register(oracle.query(oracle.rotated(PLAIN), "select angle_id, line, pos, dem_id from rotated"))
def rotated_cells_all_angles(spark, sf_dir):
    return rotation.rotated_cells(spark, PLAIN)


@register(oracle.query(oracle.lines(PLAIN), "select angle_id, line, pos, dem_id, coalesce(elev, -32768) as elev from gathered"))
def line_elevations_all_angles(spark, sf_dir):
    cells = sight.gather(rotation.rotated_cells(spark, PLAIN), _dem(spark, sf_dir), PLAIN)
    return cells.select("angle_id", "line", "pos", "dem_id", F.coalesce("elev", F.lit(-32768)).alias("elev"))


@register(oracle.query(oracle.lines(PLAIN), "select angle_id, line, pos, dem_id, elev from lines"))
def line_filled_all_angles(spark, sf_dir):
    return sight.lines(_dem(spark, sf_dir), PLAIN).select("angle_id", "line", "pos", "dem_id", "elev")


@register(oracle.query(oracle.dem(PLAIN), f"select dem_id, {oracle.tvs(PLAIN)} as tvs_id from dem where {oracle.circle(PLAIN)}"))
def computable_points(spark, sf_dir):
    dem = _dem(spark, sf_dir).where(grid.is_computable(F.col("dem_id"), PLAIN.width))
    return dem.select("dem_id", grid.tvs_id(F.col("dem_id"), PLAIN.width).alias("tvs_id"))


@register(
    oracle.query(
        oracle.dem(PLAIN),
        f"select cast({oracle.tvs(PLAIN)} as bigint) as tvs, dem_id, cast(dem_id % 48 as integer) as x, cast(dem_id // 48 as integer) as y, {oracle.circle(PLAIN)} as computable"
        " from dem where dem_id // 48 between 16 and 31 and dem_id % 48 between 16 and 31",
    )
)
def tvs_dem_mapping(spark, sf_dir):
    ids = spark.range(PLAIN.reach**2).select(F.col("id").alias("tvs"))
    mapped = ids.withColumn("dem_id", grid.dem_id_of(F.col("tvs"), PLAIN.width))
    dem_id = F.col("dem_id")
    return mapped.withColumns({"x": grid.column_of(dem_id, PLAIN.width), "y": grid.row_of(dem_id, PLAIN.width), "computable": grid.tvs_id(dem_id, PLAIN.width) >= 0})


@register(oracle.query(oracle.steps(PLAIN), "select k, d, round(adj * 1e6::double, 3) as adj_micro from steps"))
def step_table(spark, sf_dir):
    return sight.step_table(spark, PLAIN).select("k", "d", F.round(F.col("adj").cast("double") * 1e6, 3).alias("adj_micro"))


@register(oracle.query(oracle.slopes(PLAIN, [30]), "select dem_id, angle_id, k, round(slope::double, 4) as slope from views"))
def slopes(spark, sf_dir):
    made = sight.slopes(sight.lines(_dem(spark, sf_dir), PLAIN, [30]), PLAIN)
    return made.select("dem_id", "angle_id", "k", F.round(F.col("slope").cast("double"), 4).alias("slope"))


@register(oracle.query(oracle.slopes(PLAIN), "select dem_id, angle_id, k, round(slope::double, 4) as slope from views"))
def slopes_all_angles(spark, sf_dir):
    made = sight.slopes(sight.lines(_dem(spark, sf_dir), PLAIN), PLAIN)
    return made.select("dem_id", "angle_id", "k", F.round(F.col("slope").cast("double"), 4).alias("slope"))


@register(oracle.query(oracle.visibility(PLAIN, FEW), "select dem_id, angle_id, k, visible from seen"))
def visibility_bitmap(spark, sf_dir):
    return _seen(spark, sf_dir, angles=FEW).select("dem_id", "angle_id", "k", "visible")


@register(oracle.query(oracle.visibility(PLAIN), "select dem_id, angle_id, k, visible from seen"))
def visibility_bitmap_all_angles(spark, sf_dir):
    return _seen(spark, sf_dir).select("dem_id", "angle_id", "k", "visible")


@register(oracle.query(oracle.surfaces(PLAIN), "select dem_id, sum_k from surfaces"))
def total_surfaces(spark, sf_dir):
    return aggregate.total_surfaces(_seen(spark, sf_dir))


@register(oracle.query(oracle.surfaces(PLAIN), "select dem_id, sum_k, longest_k, longest_angle from surfaces join longest using (dem_id)"))
def kernel_surfaces(spark, sf_dir):
    return kernel.surfaces(_dem(spark, sf_dir), PLAIN)


@register(oracle.query(oracle.surfaces(PLAIN), "select dem_id, longest_k, longest_angle from longest"))
def longest_lines(spark, sf_dir):
    return aggregate.longest_lines(_seen(spark, sf_dir))


@register(oracle.query(oracle.surfaces(PLAIN), "select dem_id, longest_k * 1024 + longest_angle as packed, longest_k as distance, longest_angle as angle from longest"))
def longest_lines_packed(spark, sf_dir):
    best = aggregate.longest_lines(_seen(spark, sf_dir))
    packed = best.select("dem_id", aggregate.pack_line(F.col("longest_k"), F.col("longest_angle"), PLAIN).alias("packed"))
    return packed.withColumns({"distance": aggregate.unpack_distance(F.col("packed")), "angle": aggregate.unpack_angle(F.col("packed"))})


@register(oracle.query(oracle.visibility(PLAIN), "select angle_id, cast(sum(k) as bigint) as sum_k, count(*) as n_visible from seen where visible group by angle_id"))
def surface_by_angle(spark, sf_dir):
    return _seen(spark, sf_dir).where("visible").groupBy("angle_id").agg(F.sum(F.col("k").cast("long")).alias("sum_k"), F.count("*").alias("n_visible"))


def _variant(name: str, settings: Settings) -> None:
    def query(spark, sf_dir):
        return kernel.surfaces(_dem(spark, sf_dir, settings), settings)

    query.__name__ = name
    register(oracle.query(oracle.surfaces(settings), "select dem_id, sum_k, longest_k, longest_angle from surfaces join longest using (dem_id)"))(query)


_variant("refraction_variant", Settings(48, refraction=-12_756_274.0))
_variant("scale_variant", Settings(48, scale=100.0))
_variant("observer_height_variant", Settings(48, observer_height=20.0))
_variant("angle_subdivisions_2", Settings(36, subdivisions=2))


@register(oracle.query(oracle.surfaces(PLAIN, None, "p.dem_id % 48 between 19 and 28 and p.dem_id // 48 between 18 and 27"), "select dem_id, sum_k from surfaces"))
def aoi_total_surfaces(spark, sf_dir):
    return aggregate.total_surfaces(_seen(spark, sf_dir, observers=interest.inside(F.col("dem_id"), PLAIN.width, AREA)))


@register(oracle.query(oracle.dem(PLAIN), f"select dem_id, {oracle.neighbourhood(PLAIN, BLOCK)} as neighbourhood_id from dem"))
def neighbourhood_ids(spark, sf_dir):
    return _dem(spark, sf_dir).select("dem_id", grid.neighbourhood_id(F.col("dem_id"), PLAIN.width, BLOCK).alias("neighbourhood_id"))


_BEST = f"""blocks as (select dem_id, {oracle.neighbourhood(PLAIN, BLOCK)} as neighbourhood_id, sum_k from dense),
best as (select neighbourhood_id, dem_id, row_number() over (partition by neighbourhood_id order by sum_k desc, dem_id) as place from blocks)"""


def _best(spark, sf_dir):
    third = aggregate.dense(kernel.surfaces(_dem(spark, sf_dir), PLAIN), PLAIN, ["sum_k"])
    return aggregate.best_in_neighbourhoods(third.withColumn("dem_id", grid.dem_id_of(F.col("tvs_id"), PLAIN.width)), PLAIN, BLOCK)


@register(oracle.query(f"{oracle.dense(PLAIN)},\n{_BEST}", "select neighbourhood_id, dem_id from best where place = 1"))
def neighbourhood_best(spark, sf_dir):
    return _best(spark, sf_dir)


_KEPT = oracle.segments(PLAIN) + "," + oracle.dense(PLAIN)[len(oracle.visibility(PLAIN)) + 2 :] + f",\n{_BEST}"


@register(oracle.query(_KEPT, "select dem_id, angle_id, start, distance from segs where dem_id in (select dem_id from best where place = 1)"))
def whitelisted_segments(spark, sf_dir):
    return segments.whitelisted(_segments(spark, sf_dir), _best(spark, sf_dir))


@register(oracle.query(oracle.segments(PLAIN), "select dem_id, angle_id, start, distance from segs"))
def polar_segments(spark, sf_dir):
    return segments.polar_segments(_seen(spark, sf_dir))


@register(oracle.query(oracle.segments(PLAIN), "select dem_id, angle_id, start, distance from segs"))
def kernel_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@register(oracle.query(oracle.segments(PLAIN), "select dem_id, angle_id, start::bigint * 65536 + distance as packed from segs"))
def segments_packed(spark, sf_dir):
    return _segments(spark, sf_dir).select("dem_id", "angle_id", segments.pack(F.col("start"), F.col("distance")).alias("packed"))


@register(oracle.query(oracle.segments(PLAIN), "select dem_id, angle_id, start, distance from segs"))
def segments_roundtrip(spark, sf_dir):
    return segments.decoded(segments.stored(_segments(spark, sf_dir)))


_HEX = "string_agg(lpad(hex(start::bigint * 65536 + distance), 8, '0'), '' order by start)"
_STORED = f"{oracle.segments(PLAIN)},\nrows as (select dem_id, angle_id, {_HEX} as segments_hex from segs group by dem_id, angle_id)"


def _hex(rows: DataFrame) -> DataFrame:
    return rows.select("angle_id", "dem_id", F.hex("visible_segments").alias("segments_hex"))


@register(oracle.query(_STORED, "select angle_id, dem_id, segments_hex from rows where dem_id = 1128"))
def segment_lookup_dem(spark, sf_dir):
    return _hex(segments.lookup(segments.stored(_segments(spark, sf_dir)), dem_id=1128))


@register(
    oracle.query(
        f"{_STORED},\nnear as (select *, row_number() over (partition by angle_id order by dem_id) as place from rows where {oracle.neighbourhood(PLAIN, BLOCK)} = 65)",
        "select angle_id, dem_id, segments_hex from near where place = 1",
    )
)
def segment_lookup_neighbourhood(spark, sf_dir):
    block = grid.neighbourhood_id(F.col("dem_id"), PLAIN.width, BLOCK)
    return _hex(segments.lookup(segments.stored(_segments(spark, sf_dir), block), neighbourhood_id=65))


_PAIRS = (
    "select a.dem_id, a.angle_id, a.start, a.distance, b.start as next_start, b.distance as next_distance from segs a join segs b on a.dem_id = b.dem_id and {0}"
    " where a.start < b.start + b.distance and b.start < a.start + a.distance"
)


@register(oracle.query(oracle.segments(PLAIN), _PAIRS.format("b.angle_id = a.angle_id + 1")))
def segment_contacts(spark, sf_dir):
    return segments.contacts(_segments(spark, sf_dir), PLAIN.angles)


@register(oracle.query(oracle.segments(PLAIN), _PAIRS.format("a.angle_id = 359 and b.angle_id = 0")))
def segment_wrap_contacts(spark, sf_dir):
    return segments.contacts(_segments(spark, sf_dir), PLAIN.angles, wrap=True)


@register(oracle.query(oracle.components(PLAIN), "select dem_id, components from groups"))
def viewshed_components(spark, sf_dir):
    return polygons.component_counts(_segments(spark, sf_dir), PLAIN.angles)


@register()
def viewshed_polygons(spark, sf_dir):
    return polygons.viewshed_polygons(_segments(spark, sf_dir), PLAIN)


@register(
    oracle.query(
        oracle.components(PLAIN) + ",\nareas as (select dem_id, round(sum((start + distance) ** 2 - start ** 2) * sin(pi() / 180) / 2, 4) as area from segs group by dem_id)",
        "select dem_id, components::bigint as polygons, area from groups join areas using (dem_id)",
    )
)
def viewshed_polygon_totals(spark, sf_dir):
    made = polygons.viewshed_polygons(_segments(spark, sf_dir), PLAIN)
    return made.groupBy("dem_id").agg(F.count("*").alias("polygons"), F.round(F.sum("area"), 4).alias("area"))


@register("select 0::bigint as problems")
def viewshed_ring_problems(spark, sf_dir):
    found = polygons.invalid_rings(polygons.viewshed_polygons(_segments(spark, sf_dir), PLAIN))
    return found.agg(F.count("*").alias("problems"))


@register(
    oracle.query(
        oracle.segments(PLAIN, [0, 45, 315]),
        "select dem_id, angle_id, start, distance, "
        + ", ".join(
            f"round({r} * cos(angle_id * pi() / 180 {o} pi() / 360), 6) + 0.0::double as {n}x, round({r} * sin(angle_id * pi() / 180 {o} pi() / 360), 6) + 0.0::double as {n}y"
            for r, o, n in (("start", "+", "a"), ("start", "-", "b"), ("(start + distance)", "-", "c"), ("(start + distance)", "+", "d"))
        )
        + " from segs",
    )
)
def segment_rings(spark, sf_dir):
    made = segments.rings(segments.polar_segments(_seen(spark, sf_dir, angles=[0, 45, 315])), PLAIN.angles, PLAIN.scale)
    corners = [(F.round(F.col("ring")[i][axis], 6) + F.lit(0.0)).alias(f"{n}{axis}") for i, n in enumerate("abcd") for axis in "xy"]
    return made.select("dem_id", "angle_id", "start", "distance", *corners)


@register(
    oracle.query(
        oracle.segments(PLAIN),
        "select dem_id, angle_id, start, distance, "
        + ", ".join(
            f"round({r} * cos(angle_id * pi() / 180 {o} pi() / 360), 6) + 0.0::double as {n}x, round({r} * sin(angle_id * pi() / 180 {o} pi() / 360), 6) + 0.0::double as {n}y"
            for r, o, n in (("start", "+", "a"), ("start", "-", "b"), ("(start + distance)", "-", "c"), ("(start + distance)", "+", "d"))
        )
        + " from segs",
    )
)
def segment_rings_all_angles(spark, sf_dir):
    made = segments.rings(segments.polar_segments(_seen(spark, sf_dir)), PLAIN.angles, PLAIN.scale)
    corners = [(F.round(F.col("ring")[i][axis], 6) + F.lit(0.0)).alias(f"{n}{axis}") for i, n in enumerate("abcd") for axis in "xy"]
    return made.select("dem_id", "angle_id", "start", "distance", *corners)


@register(
    oracle.query(
        oracle.segments(PLAIN),
        "select dem_id, cast(sum((start + distance) * (start + distance) - start * start) as bigint) as ring_sum,"
        " round(cast(sum((start + distance) * (start + distance) - start * start) as double) * (pi() / 360), 4) as area from segs group by dem_id",
    )
)
def viewshed_area(spark, sf_dir):
    return segments.area(_segments(spark, sf_dir), PLAIN.angles, PLAIN.scale).withColumn("area", F.round("area", 4))


def _values(spark, sf_dir):
    third = aggregate.dense(kernel.surfaces(_dem(spark, sf_dir), PLAIN), PLAIN, ["sum_k"])
    return third.withColumn("value", aggregate.surface(F.col("sum_k"), PLAIN))


def _heatmap(method: str):
    def query(spark, sf_dir):
        return normalise.normalise(_values(spark, sf_dir), method).select("tvs_id", F.round("normal", 6).alias("normal"))

    return query


_UNIT = "select tvs_id, (value - min(value) over ()) / (max(value) over () - min(value) over ()) as normal from dense"
_WELFORD = """scored as (select tvs_id, (value - avg(value) over ()) / greatest(stddev_pop(value) over (), 1.1920929e-07::double) as z from dense),
stretched as (select tvs_id, (z - min(z) over ()) / (max(z) over () - min(z) over ()) as v from scored),
once as (select tvs_id, least(greatest(v + 0.5::double - avg(v) over (), 0), 1) as v from stretched),
means as (select tvs_id, v, avg(v) over () as m from once),
twice as (select tvs_id, least(greatest(v + case when abs(m - 0.5::double) > 1.1920929e-07::double then 0.5::double - m else 0 end, 0), 1) as v from means)"""
_HEATMAPS = {
    "unit": oracle.query(f"{oracle.dense(PLAIN)}, u as ({_UNIT})", "select tvs_id, round(normal, 6) as normal from u"),
    "exponential": oracle.query(oracle.dense(PLAIN), "select tvs_id, round(sqrt(value / max(value) over ()), 6) as normal from dense"),
    "welford": oracle.query(f"{oracle.dense(PLAIN)},\n{_WELFORD}", "select tvs_id, round(v, 6) as normal from twice"),
}
for _method, _sql in _HEATMAPS.items():
    QUERIES[f"heatmap_{_method}"] = _heatmap(_method)
    ORACLE_SQL[f"heatmap_{_method}"] = _sql


@register(oracle.query(oracle.dense(PLAIN), "select tvs_id, cast(floor(sqrt(value / max(value) over ()) * 255) as integer) as pixel from dense"))
def heatmap_pixels(spark, sf_dir):
    return normalise.exponential(_values(spark, sf_dir)).select("tvs_id", normalise.pixel(F.col("normal")).alias("pixel"))


@register("""select 48 as width, 1.0::double as scale, 16 as max_line_of_sight, 0.0::double as centre_lon, 0.0::double as centre_lat, 16 as neighbourhood_size, 1 as angle_subdivisions""")
def metadata_json(spark, sf_dir):
    return read_metadata(metadata_row(spark, Settings(48, neighbourhood=BLOCK)))


#: Longitude and latitude of the grid's centre in the geodesy queries, and metres between its cells.
ANCHOR = (-2.5879, 51.4545)
CELL = 100.0


def _metres() -> tuple:
    dem_id = F.col("dem_id")
    middle = (PLAIN.width - 1) / 2
    return (grid.column_of(dem_id, PLAIN.width) - middle) * CELL, (middle - grid.row_of(dem_id, PLAIN.width)) * CELL


_METRES = f"metres as (select range as dem_id, (range % 48 - 23.5::double) * {CELL} as east, (23.5::double - range // 48) * {CELL} as north from range(2304))"
_DEGREES = f"{_METRES},\n" + oracle.geodesic("metres", "placed", f"{ANCHOR[0]}::double", f"{ANCHOR[1]}::double", "east", "north")


@register(oracle.query(_DEGREES, "select dem_id, round(lon, 9) as lon, round(lat, 9) as lat from placed"))
def geodesy_inverse(spark, sf_dir):
    at = geodesy.to_degrees(*_metres(), *ANCHOR)
    return _dem(spark, sf_dir).select("dem_id", at.alias("at")).select("dem_id", F.round("at.lon", 9).alias("lon"), F.round("at.lat", 9).alias("lat"))


@register(f"select range as dem_id, (range % 48 - 23.5::double) * {CELL} + 0.0::double as x, (23.5::double - range // 48) * {CELL} + 0.0::double as y from range(2304)")
def geodesy_forward(spark, sf_dir):
    """Metres of every cell after a round trip through longitude and latitude."""
    there = _dem(spark, sf_dir).select("dem_id", geodesy.to_degrees(*_metres(), *ANCHOR).alias("at"))
    back = there.select("dem_id", geodesy.to_metres(F.col("at.lon"), F.col("at.lat"), *ANCHOR).alias("m"))
    return back.select("dem_id", (F.round("m.x", 5) + F.lit(0.0)).alias("x"), (F.round("m.y", 5) + F.lit(0.0)).alias("y"))


#: The grid of the queries that give longitudes and latitudes.
PLACED = Settings(48, scale=CELL, centre=ANCHOR)
_HALF = {"a": ("start", "+"), "b": ("start", "-"), "c": ("(start + distance)", "-"), "d": ("(start + distance)", "+")}
_CORNERS = ", ".join(f"({r} * {CELL} * cos(radians(angle_id {o} 0.5::double)), {r} * {CELL} * sin(radians(angle_id {o} 0.5::double)))" for r, o in _HALF.values())
_BOUNDS = ",\n".join(
    [
        oracle.segments(PLACED), _DEGREES,
        "corners as (select dem_id, lon as lon0, lat as lat0, unnest([" + _CORNERS.replace("(start * ", "struct_pack(x := start * ").replace("((start + distance) * ", "struct_pack(x := (start + distance) * ").replace(", start *", ", y := start *").replace(", (start + distance) *", ", y := (start + distance) *") + "]) as p"
        " from segs join placed using (dem_id) where distance > 0)",
        "points as (select dem_id, lon0, lat0, p.x as x, p.y as y from corners)",
        oracle.geodesic("points", "seen_at", "lon0", "lat0", "x", "y"),
    ]
)


def _placed_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kernel.segments(_dem(spark, sf_dir, PLACED), PLACED)
    return polygons.in_degrees(polygons.viewshed_polygons(found, PLACED), PLACED)


@register(oracle.query(_BOUNDS, "select dem_id, round(min(lon), 8) as west, round(min(lat), 8) as south, round(max(lon), 8) as east, round(max(lat), 8) as north from seen_at group by dem_id"))
def viewshed_bounds(spark, sf_dir):
    """The corners of the box about each observer's viewshed, in degrees."""
    x, y = F.transform("exterior", lambda p: p["x"]), F.transform("exterior", lambda p: p["y"])
    ends = {"west": F.array_min(x), "south": F.array_min(y), "east": F.array_max(x), "north": F.array_max(y)}
    each = _placed_polygons(spark, sf_dir).select("dem_id", *[e.alias(n) for n, e in ends.items()])
    return each.groupBy("dem_id").agg(*[F.round(f(n), 8).alias(n) for f, n in ((F.min, "west"), (F.min, "south"), (F.max, "east"), (F.max, "north"))])


@register()
def viewshed_geojson(spark, sf_dir):
    return polygons.geojson_rows(_placed_polygons(spark, sf_dir))


@register(oracle.query(oracle.surfaces(PLAIN, None, "p.dem_id % 48 between 19 and 28 and p.dem_id // 48 between 18 and 27"), "select dem_id, sum_k, longest_k, longest_angle from surfaces join longest using (dem_id)"))
def aoi_kernel_surfaces(spark, sf_dir):
    wanted = spark.range(PLAIN.width**2).select(F.col("id").alias("dem_id")).where(interest.inside(F.col("dem_id"), PLAIN.width, AREA))
    return kernel.surfaces(_dem(spark, sf_dir), PLAIN, observers=wanted)
