"""Viewshed polygons from segments.

The segments of one observer are sectors between half angle steps. Where two
neighbouring sectors overlap they melt together, so what bounds the viewshed
are the chords of each segment's two ends, and on each ray between two angles
the stretches that only one side sees. These directed edges, visible side on
the left, are made by Spark (`boundary`): the stretches are what lies between cuts
of a ray, sorted, where one side's runs are open and the other's are not. In a
task the edges of one observer chain into closed rings: counter-clockwise ones
are polygons, clockwise ones holes. At a corner where rings touch, the chain
turns left as sharply as it can, so polygons that only meet in a point stay apart.

One observer has at most angles x reach segments, which bounds a group.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geodesy import to_degrees
from ..functions.grid import column_of, row_of
from ..settings import Settings
from .segments import unpack_distance, unpack_start

#: A corner: the ray (in half angle steps) and the radius in cells; the centre is one corner for all rays.
Corner = tuple[int, int]
CENTRE: Corner = (-1, 0)


def boundary(segments: DataFrame, angles: int) -> DataFrame:
    """(dem_id, ray, radius, to_ray, to_radius): the directed edges of every observer's viewshed; rays are counted in half angle steps."""
    rays = 2 * angles

    def edge(ray: Column, radius: Column, to_ray: Column, to_radius: Column) -> Column:
        def turn(ray: Column, radius: Column) -> Column:
            return F.when(radius == 0, F.lit(CENTRE[0])).otherwise(F.pmod(ray, F.lit(rays)))

        names = ("ray", "radius", "to_ray", "to_radius")
        ends = (turn(ray, radius), radius, turn(to_ray, to_radius), to_radius)
        return F.struct(*[v.cast("int").alias(n) for n, v in zip(names, ends, strict=True)])

    here = F.col("angle_id")
    spans = segments.where("distance > 0").select("dem_id", "angle_id", "start", (F.col("start") + F.col("distance")).alias("end")).repartition("dem_id")
    before, after = 2 * here - 1, 2 * here + 1
    near = F.when(F.col("start") > 0, edge(after, F.col("start"), before, F.col("start")))
    chords = spans.select("dem_id", F.inline(F.array_compact(F.array(edge(before, F.col("end"), after, F.col("end")), near))))

    def cut(ray: Column, radius: Column, mine: int, others: int) -> Column:
        return F.struct(F.pmod(ray, F.lit(angles)).alias("after"), radius.alias("low"), F.lit(mine).alias("mine"), F.lit(others).alias("others"))

    # `mine` opens and closes runs of the angle before a ray, `others` of the angle behind it.
    cuts = spans.select(
        "dem_id", F.inline(F.array(cut(here, F.col("start"), 1, 0), cut(here, F.col("end"), -1, 0), cut(here - 1, F.col("start"), 0, 1), cut(here - 1, F.col("end"), 0, -1)))
    )
    cuts = cuts.groupBy("dem_id", "after", "low").agg(F.sum("mine").alias("mine"), F.sum("others").alias("others"))
    along = W.partitionBy("dem_id", "after").orderBy("low")
    open_now = cuts.select(
        "dem_id", (2 * F.col("after") + 1).alias("on"), "low", F.lead("low").over(along).alias("high"), (F.sum("mine").over(along) > 0).alias("mine"), (F.sum("others").over(along) > 0).alias("others")
    )
    on, low, high = F.col("on"), F.col("low"), F.col("high")
    stretch = F.when(F.col("others"), edge(on, low, on, high)).otherwise(edge(on, high, on, low))
    return chords.unionByName(open_now.where(F.col("mine") != F.col("others")).select("dem_id", stretch.alias("e")).select("dem_id", "e.*"))


def place(corner: Corner, angles: int) -> tuple[float, float]:
    turn = corner[0] * math.pi / angles
    return (corner[1] * math.cos(turn), corner[1] * math.sin(turn)) if corner != CENTRE else (0.0, 0.0)


def chain(directed: Iterable[tuple[Corner, Corner]], angles: int) -> list[list[Corner]]:
    """Directed edges as closed rings, without repeating the first corner."""
    onward: dict[Corner, list[Corner]] = defaultdict(list)
    for a, b in directed:
        onward[a].append(b)
    at = {c: place(c, angles) for c in [*onward, *(b for bs in onward.values() for b in bs)]}

    def heading(a: Corner, b: Corner) -> float:
        return math.atan2(at[b][1] - at[a][1], at[b][0] - at[a][0])

    rings = []
    for first in sorted(onward):
        while onward[first]:
            ring, here = [first], onward[first].pop()
            while here != first or any(onward[here]) and _turns_on(onward[here], ring, here, heading):
                before = heading(ring[-1], here)
                ring.append(here)
                # Visible ground is on the left: the leftmost turn keeps to the same piece of it.
                choices = onward[here]
                choices.sort(key=lambda b: (heading(here, b) - before + math.pi) % (2 * math.pi))
                here = choices.pop()
            rings.append(ring)
    return rings


def _turns_on(choices: list, ring: list, here: Corner, heading) -> bool:
    """At the first corner again: whether some edge onward turns further left than the ring's first edge."""
    before = heading(ring[-1], here)
    left = lambda b: (heading(here, b) - before + math.pi) % (2 * math.pi)
    return max(map(left, choices)) > left(ring[1]) if len(ring) > 1 else False


def signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def _inside(point: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    x, y = point
    within = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            within = not within
    return within


def assemble(directed: Iterable[tuple[Corner, Corner]], angles: int, scale: float = 1.0) -> list[dict]:
    """Polygons {exterior, interiors} of one viewshed's edges; rings are closed lists of (x, y) in metres, y up."""
    shells, holes = [], []
    for ring in chain(directed, angles):
        points = [place(c, angles) for c in ring]
        (shells if signed_area(points) > 0 else holes).append(points)
    polygons = [{"exterior": s, "interiors": []} for s in sorted(shells, key=lambda r: -abs(signed_area(r)))]
    for hole in holes:
        (x1, y1), (x2, y2) = hole[:2]
        size = math.hypot(x2 - x1, y2 - y1) or 1.0
        probe = ((x1 + x2) / 2 - (y2 - y1) / size * 1e-6, (y1 + y2) / 2 + (x2 - x1) / size * 1e-6)
        owner = next((p for p in reversed(polygons) if _inside(probe, p["exterior"])), None)
        (owner or polygons[0])["interiors"].append(hole)

    def scaled(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
        return [(x * scale, y * scale) for x, y in [*ring, ring[0]]]

    return [{"exterior": scaled(p["exterior"]), "interiors": [scaled(h) for h in p["interiors"]]} for p in polygons]


RING = "array<struct<x:double,y:double>>"
SCHEMA = f"dem_id long, polygon_id int, exterior {RING}, interiors array<{RING}>, area double"


def viewshed_polygons(segments: DataFrame, settings: Settings) -> DataFrame:
    """One row for each polygon of each observer; area is the exterior's less the holes'."""
    return _polygons_at(segments, settings.angles, settings.scale)


def _polygons_at(segments: DataFrame, angles: int, scale: float) -> DataFrame:
    def built(group: pd.DataFrame) -> pd.DataFrame:
        directed = [((a, b), (c, d)) for a, b, c, d in group[["ray", "radius", "to_ray", "to_radius"]].sort_values(["ray", "radius", "to_ray", "to_radius"]).to_numpy().tolist()]
        rows = []
        for n, p in enumerate(assemble(directed, angles, scale)):
            area = abs(signed_area(p["exterior"][:-1])) - sum(abs(signed_area(h[:-1])) for h in p["interiors"])
            as_rows = lambda ring: [{"x": x, "y": y} for x, y in ring]
            rows.append((int(group["dem_id"].iloc[0]), n, as_rows(p["exterior"]), [as_rows(h) for h in p["interiors"]], area))
        return pd.DataFrame(rows, columns=["dem_id", "polygon_id", "exterior", "interiors", "area"])

    return boundary(segments, angles).groupBy("dem_id").applyInPandas(built, SCHEMA)


def invalid_rings(polygons: DataFrame) -> DataFrame:
    """(dem_id, polygon_id, ring, problem) of rings that break a rule; a sound table gives no rows.

    ring: 0 for the exterior, then the interiors from 1. The rules: no ring is empty
    or has fewer than four corners with the last, ends where it starts, repeats
    a corner one after another, or has a coordinate that is no finite number; an exterior runs
    counter-clockwise, an interior clockwise; no two edges of a ring cross. Corners and
    edges of a ring may touch: that is how a viewshed pinches.
    """

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for n, ring in enumerate([row["exterior"], *row["interiors"]]):
                    points = [(p["x"], p["y"]) for p in ring]
                    out += [{"dem_id": row["dem_id"], "polygon_id": row["polygon_id"], "ring": n, "problem": problem} for problem in ring_problems(points, n > 0)]
            yield pa.RecordBatch.from_pylist(out, PROBLEMS)

    return polygons.select("dem_id", "polygon_id", "exterior", "interiors").mapInArrow(checked, "dem_id long, polygon_id int, ring int, problem string")


PROBLEMS = pa.schema([("dem_id", pa.int64()), ("polygon_id", pa.int32()), ("ring", pa.int32()), ("problem", pa.string())])


def ring_problems(points: list[tuple[float, float]], hole: bool = False) -> list[str]:
    """What is wrong with a closed ring; see `invalid_rings`."""
    if not points:
        return ["empty"]
    if not np.isfinite(points).all():
        return ["not finite"]
    out = []
    if points[0] != points[-1]:
        out.append("not closed")
    if len(points) < 4:
        return [*out, "too few corners"]
    if any(a == b for a, b in zip(points, points[1:], strict=False)):
        out.append("repeated corner")
    area = signed_area(points[:-1])
    if area == 0:
        out.append("no area")
    elif (area < 0) != hole:
        out.append("wrong direction")
    if _crosses(np.array(points)):
        out.append("edges cross")
    return out


def _crosses(points: np.ndarray) -> bool:
    """Whether two edges of a ring cross in their insides, compared one with all others at a time."""
    a, b = points[:-1], points[1:]
    slack = 1e-9 * max(1.0, float(np.abs(points).max())) ** 2

    def side(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        cross = (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
        return np.where(np.abs(cross) <= slack, 0, np.sign(cross))

    for k in range(len(a) - 1):
        c, d = a[k + 1 :], b[k + 1 :]
        if np.any((side(a[k], b[k], c) * side(a[k], b[k], d) < 0) & (side(c, d, a[k]) * side(c, d, b[k]) < 0)):
            return True
    return False


def segments_of_arrays(views: DataFrame) -> DataFrame:
    """(dem_id, angle_id, start, distance) from rows (dem_id, angles), where `angles` holds an array of segments for each of the equally spaced angles.

    A segment is a struct (start, distance), or both packed in one number.
    """
    each = views.select("dem_id", F.posexplode("angles").alias("angle_id", "runs")).select("dem_id", "angle_id", F.explode("runs").alias("run"))
    run = F.col("run")
    if isinstance(each.schema["run"].dataType, StructType):
        start, distance = run["start"].cast("int"), run["distance"].cast("int")
    else:
        start, distance = unpack_start(run.cast("long")), unpack_distance(run.cast("long"))
    return each.select("dem_id", "angle_id", start.alias("start"), distance.alias("distance"))


def polygons_of_arrays(views: DataFrame, angles: int, scale: float = 1.0) -> DataFrame:
    """Polygons of views given as nested arrays, all with the same number of angles (of any size)."""
    return _polygons_at(segments_of_arrays(views), angles, scale)


def flattened_rings(polygons: DataFrame) -> DataFrame:
    """(dem_id, polygon_id, exterior, interiors, hole_indices): rings as flat arrays x, y, x, y, ...; all holes in one, and where in it each begins."""
    def flat(ring: Column) -> Column:
        return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))

    # Each begins where those before it end: as many numbers as they have together.
    sizes = polygons.withColumn("sizes", F.transform("interiors", lambda ring: 2 * F.size(ring)))
    begins = F.expr("transform(sizes, (size, n) -> aggregate(slice(sizes, 1, n), 0, (total, one) -> total + one))")
    return sizes.select("dem_id", "polygon_id", flat(F.col("exterior")).alias("exterior"), flat(F.flatten("interiors")).alias("interiors"), begins.alias("hole_indices"))


def component_counts(segments: DataFrame, angles: int, wrap: bool = True) -> DataFrame:
    """(dem_id, components): groups of segments that overlap on neighbouring angles, one after another."""

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["distance"] > 0]
        by_angle: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for n, (angle, start, distance) in enumerate(zip(group["angle_id"], group["start"], group["distance"], strict=True)):
            by_angle[int(angle)].append((n, int(start), int(start + distance)))
        root = list(range(len(group)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for angle, spans in by_angle.items():
            if angle == angles - 1 and not wrap:
                continue
            for n, low, high in spans:
                for m, other_low, other_high in by_angle.get((angle + 1) % angles, []):
                    if low < other_high and other_low < high:
                        root[find(n)] = find(m)
        return pd.DataFrame({"dem_id": [int(d) for d in group["dem_id"].iloc[:1]], "components": [len({find(x) for x in root})] if len(group) else []})

    return segments.groupBy("dem_id").applyInPandas(counted, "dem_id long, components int")


def in_degrees(polygons: DataFrame, settings: Settings) -> DataFrame:
    """Polygons with x and y as longitude and latitude, each about its own observer's cell."""
    half = F.lit((settings.width - 1) / 2)
    dem_id = F.col("dem_id")
    cell = to_degrees((column_of(dem_id, settings.width) - half) * settings.scale, (half - row_of(dem_id, settings.width)) * settings.scale, *settings.centre)
    rings = F.concat(F.array("exterior"), F.col("interiors"))
    corners = polygons.select("dem_id", "polygon_id", "area", cell.alias("cell"), F.posexplode(rings).alias("ring", "points"))
    corners = corners.select("dem_id", "polygon_id", "area", "cell", "ring", F.posexplode("points").alias("at", "p"))
    moved = corners.withColumn("p", to_degrees(F.col("p.x"), F.col("p.y"), F.col("cell.lon"), F.col("cell.lat")))
    point = F.struct("ring", "at", F.struct(F.col("p.lon").alias("x"), F.col("p.lat").alias("y")).alias("p"))
    whole = moved.groupBy("dem_id", "polygon_id").agg(F.first("area").alias("area"), F.sort_array(F.collect_list(point)).alias("points"), (F.max("ring") + 1).alias("n"))
    ring_of = lambda k: F.transform(F.filter("points", lambda p: p["ring"] == k), lambda p: p["p"])
    holes = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(1), F.col("n") - 1), ring_of)).otherwise(F.array().cast(f"array<{RING}>"))
    return whole.select("dem_id", "polygon_id", ring_of(F.lit(0)).alias("exterior"), holes.alias("interiors"), "area")


def geojson_rows(polygons: DataFrame) -> DataFrame:
    """(dem_id, geojson): of each observer a FeatureCollection with one MultiPolygon of polygons in longitude and latitude."""
    pair = lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    shape = F.concat(F.array(pair(F.col("exterior"))), F.transform("interiors", pair))
    whole = polygons.select("dem_id", F.struct("polygon_id", shape.alias("shape")).alias("one")).groupBy("dem_id").agg(F.sort_array(F.collect_list("one"))["shape"].alias("coordinates"))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), "coordinates")
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map().cast("map<string,string>").alias("properties"), geometry.alias("geometry"))
    return whole.select("dem_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("geojson"))
