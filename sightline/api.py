"""What a user runs: compute, viewshed, optimise_layout; also from the command line."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geodesy
from .functions.grid import dem_id_of, in_central_square, neighbourhood_id
from .operators import aggregate, interest, kernel, polygons, segments
from .plans.metadata import settings_of
from .settings import Settings
from .sources import dem as dem_source
from .sources import sinks

PROCESSES = ("all", "viewsheds")


def aoi_polygon(points: list[tuple[float, float]], settings: Settings) -> list[tuple[float, float]]:
    """Longitudes and latitudes as (column, row) corners."""
    if not points:
        return []
    x, y = geodesy.forward(np.array([p[0] for p in points]), np.array([p[1] for p in points]), *settings.centre)
    half = (settings.width - 1) / 2
    return [(float(a / settings.scale + half), float(half - b / settings.scale)) for a, b in zip(x, y, strict=True)]


def compute(
    dem: DataFrame, settings: Settings, process: str = "all", heatmap: str = "exponential", aoi: list[tuple[float, float]] | None = None, output: str | None = None,
    images: bool = True, segments_path: str | None = None, best_source: DataFrame | None = None,
) -> DataFrame | None:
    """Surfaces and longest lines of every observer, and heatmaps and stored segments where paths are given.

    process: all, or viewsheds for segments alone. aoi: corners in longitude and
    latitude. best_source: an earlier (tvs_id, value) heatmap; with a neighbourhood
    set, only the best observer of each block is stored.
    """
    if process not in PROCESSES:
        raise ValueError(f"process must be one of {PROCESSES}")
    if settings.neighbourhood and best_source is None and segments_path:
        raise ValueError("keeping only the best viewsheds wants an earlier heatmap as source")
    area = aoi_polygon(aoi or [], settings)
    cells = dem.sparkSession.range(settings.width**2).select(F.col("id").alias("dem_id"))
    wanted = cells.where(in_central_square(F.col("dem_id"), settings.width) & interest.inside(F.col("dem_id"), settings.width, area)) if area else None
    surfaces = None
    if process == "all":
        surfaces = kernel.surfaces(dem, settings, observers=wanted)
        sinks.save_heatmaps(surfaces, settings, output, heatmap, images)
    if segments_path:
        near = None
        if settings.neighbourhood:
            ranked = best_source.withColumn("dem_id", dem_id_of(F.col("tvs_id"), settings.width))
            best = aggregate.best_in_neighbourhoods(ranked, settings, settings.neighbourhood, by="value").select("dem_id")
            wanted = best.join(wanted, "dem_id", "left_semi") if wanted is not None else best
            near = neighbourhood_id(F.col("dem_id"), settings.width, settings.neighbourhood)
        sinks.save_segments(segments.stored(kernel.segments(dem, settings, observers=wanted), near), settings, segments_path)
    return surfaces


def viewshed(spark: SparkSession, path: str, lon: float, lat: float, output: str | None = None) -> str:
    """GeoJSON of the viewshed from the stored observer nearest to a point; where neighbourhoods were stored, from the block's best."""
    settings = settings_of(spark.read.parquet(f"{path}/metadata"))
    rows = spark.read.parquet(f"{path}/polar_segments")
    ((column, row),) = aoi_polygon([(lon, lat)], settings)
    column, row = int(np.floor(column + 0.5)), int(np.floor(row + 0.5))
    at = spark.range(1).select(F.lit(row * settings.width + column).cast("long").alias("dem_id"))
    here = at.select("dem_id", in_central_square(F.col("dem_id"), settings.width).alias("ok"), neighbourhood_id(F.col("dem_id"), settings.width, settings.neighbourhood or 1).alias("near")).first()
    if not here["ok"]:
        raise ValueError("the point lies outside the cells that can be computed")
    found = segments.lookup(rows, **({"neighbourhood_id": here["near"]} if settings.neighbourhood else {"dem_id": here["dem_id"]}))
    shapes = polygons.geojson_rows(polygons.in_degrees(polygons.viewshed_polygons(segments.decoded(found), settings), settings)).first()  # one observer
    if not shapes:
        raise ValueError("nothing is stored for that point")
    text = shapes["geojson"]
    if output:
        sinks.save_geojson(text, output, lon, lat)
    return text


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sightline")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("compute")
    c.add_argument("input")
    c.add_argument("--observer-height", type=float, default=1.65)
    c.add_argument("--refraction", type=float, default=0.13)
    c.add_argument("--process", choices=PROCESSES, default="all")
    c.add_argument("--heatmap", choices=("unit", "exponential", "welford"), default="exponential")
    c.add_argument("--angle-subdivisions", type=int, default=1)
    c.add_argument("--aoi-point", type=geodesy.parse_lonlat, action="append", default=[])
    c.add_argument("--only-save-biggest-viewsheds", type=int)
    c.add_argument("--tvs-source-path")
    c.add_argument("--viewsheds-path")
    c.add_argument("--output-dir", default="./output")
    c.add_argument("--disable-image-render", action="store_true")
    v = commands.add_parser("viewshed")
    v.add_argument("path")
    v.add_argument("output")
    v.add_argument("coords", type=geodesy.parse_lonlat, nargs="+")
    for name in ("export-sqlite", "import-sqlite"):
        x = commands.add_parser(name)
        x.add_argument("path")
        x.add_argument("target")
        x.add_argument("--shards", type=int, default=1)
    p = commands.add_parser("post-process")
    p.add_argument("path")
    p.add_argument("target")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "compute":
        dem, settings = dem_source.read_dem(
            spark, a.input, observer_height=a.observer_height, refraction=a.refraction, subdivisions=a.angle_subdivisions, neighbourhood=a.only_save_biggest_viewsheds
        )
        source = dem_source.read_heatmap(spark, a.tvs_source_path) if a.tvs_source_path else None
        compute(dem, settings, a.process, a.heatmap, a.aoi_point, a.output_dir, not a.disable_image_render, a.viewsheds_path, source)
    elif a.command == "viewshed":
        for lon, lat in a.coords:
            viewshed(spark, a.path, lon, lat, a.output)
    elif a.command == "export-sqlite":
        sinks.export_sqlite(spark.read.parquet(f"{a.path}/polar_segments"), settings_of(spark.read.parquet(f"{a.path}/metadata")), a.target, a.shards)
    elif a.command == "import-sqlite":
        rows, meta = sinks.import_sqlite(spark, a.path)
        sinks.save_segments(rows, settings_of(meta), a.target)
    else:
        sinks.optimise_layout(spark, a.path, a.target)


if __name__ == "__main__":
    main()
