"""Where results go: GeoTIFF and PNG heatmaps, GeoJSON viewsheds, stored segments."""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise
from ..operators import aggregate
from ..plans.metadata import metadata_row
from ..settings import Settings
from . import tiff


def grid_rows(values: DataFrame, column: str, width: int) -> Iterator[np.ndarray]:
    """The rows of a dense (tvs_id, column) grid in order, one at a time on the driver."""
    rows = values.groupBy(F.floor(F.col("tvs_id") / width).alias("row")).agg(F.sort_array(F.collect_list(F.struct("tvs_id", column))).alias("cells"))
    for r in rows.orderBy("row").select(F.col(f"cells.{column}").alias("v")).toLocalIterator():
        yield np.array(r["v"])


def write_png(path: str, width: int, height: int, rows: Iterator[np.ndarray]) -> None:
    """8-bit grey, compressed row by row."""
    packer, body, seen = zlib.compressobj(), b"", 0
    for row in rows:
        if len(row) != width:
            raise ValueError("a row has the wrong width")
        body += packer.compress(b"\0" + np.asarray(row, np.uint8).tobytes())
        seen += 1
    if seen != height:
        raise ValueError(f"{seen} rows for a picture of {height}")
    body += packer.flush()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b""))


def save_heatmaps(surfaces: DataFrame, settings: Settings, directory: str | None, method: str = "exponential", images: bool = True) -> None:
    """total_surfaces.tiff/png and longest_lines.tiff/png of (dem_id, sum_k, longest_k, longest_angle); without a directory nothing.

    The TIFF of longest lines holds packed bits viewed as single-precision
    numbers, which angles of more than two subdivisions do not fit: then it holds the distances.
    """
    if not directory:
        return
    os.makedirs(directory, exist_ok=True)
    reach = settings.reach
    grid = aggregate.dense(surfaces, settings, ["sum_k", "longest_k", "longest_angle"]).cache()
    metres = F.floor(F.col("longest_k") * settings.scale).cast("int")
    value = grid.withColumns({"surface": aggregate.surface(F.col("sum_k"), settings), "metres": metres})
    tiff.write(f"{directory}/total_surfaces.tiff", reach, settings.scale, settings.centre, grid_rows(value, "surface", reach))
    if settings.subdivisions <= 2:
        packed = value.withColumn("bits", aggregate.pack_line(F.col("metres"), F.col("longest_angle"), settings))
        bits = (row.astype(np.uint32).view(np.float32) for row in grid_rows(packed, "bits", reach))
    else:
        bits = grid_rows(value, "metres", reach)
    tiff.write(f"{directory}/longest_lines.tiff", reach, settings.scale, settings.centre, bits)
    if images:
        for name, column in (("total_surfaces", "surface"), ("longest_lines", "metres")):
            grey = normalise.normalise(value, method, column).withColumn("pixel", normalise.pixel(F.col("normal")))
            write_png(f"{directory}/{name}.png", reach, reach, grid_rows(grey, "pixel", reach))
    grid.unpersist()


def save_segments(rows: DataFrame, settings: Settings, path: str) -> None:
    """Write stored segments and their metadata; what the path held before is replaced."""
    rows.write.mode("overwrite").parquet(f"{path}/polar_segments")
    metadata_row(rows.sparkSession, settings).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def optimise_layout(spark: SparkSession, path: str, target: str, by: str = "neighbourhood_id") -> None:
    """Rewrite stored segments sorted by a key, so that a lookup by it prunes all but a few row groups."""
    if by not in ("neighbourhood_id", "dem_id"):
        raise ValueError("sort by neighbourhood_id or dem_id")
    rows = spark.read.parquet(f"{path}/polar_segments")
    rows.repartitionByRange(by, "dem_id", "angle_id").sortWithinPartitions(by, "dem_id", "angle_id").write.mode("overwrite").parquet(f"{target}/polar_segments")
    spark.read.parquet(f"{path}/metadata").coalesce(1).write.mode("overwrite").parquet(f"{target}/metadata")


def export_sqlite(rows: DataFrame, settings: Settings, directory: str, shards: int = 1) -> None:
    """One database for each shard, `<n>.db` in a folder that all executors share, with metadata and an index on neighbourhoods.

    A task that runs again replaces its own shard.
    """
    os.makedirs(directory, exist_ok=True)
    meta = metadata_row(rows.sparkSession, settings).first()["json"]

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        work = f"{directory}/{shard}.db.{TaskContext.get().taskAttemptId()}"
        n = 0
        with sqlite3.connect(work) as db:
            db.execute("create table metadata (json text)")
            db.execute("insert into metadata values (?)", (meta,))
            db.execute("create table polar_segments (dem_id integer, neighbourhood_id integer, angle_id integer, visible_segments blob)")
            for batch in batches:
                near = [None if pd.isna(v) else int(v) for v in batch["neighbourhood_id"]]
                records = zip(map(int, batch["dem_id"]), near, map(int, batch["angle_id"]), map(bytes, batch["visible_segments"]), strict=True)
                db.executemany("insert into polar_segments values (?, ?, ?, ?)", records)
                n += len(batch)
            db.execute("create index by_neighbourhood on polar_segments (neighbourhood_id)")
        db.close()
        os.replace(work, f"{directory}/{shard}.db")
        yield pd.DataFrame({"shard": [shard], "n": [n]})

    columns = rows.select("dem_id", "neighbourhood_id", "angle_id", "visible_segments").repartition(shards, "dem_id")
    columns.mapInPandas(store, "shard int, n long").collect()  # one row for each shard


def import_sqlite(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Stored segments and metadata rows of all `*.db` files of a folder that all executors share."""
    names = sorted(f"{directory}/{n}" for n in os.listdir(directory) if n.endswith(".db"))
    if not names:
        raise ValueError(f"no databases in {directory}")
    with sqlite3.connect(names[0]) as db:
        meta = db.execute("select json from metadata limit 1").fetchone()[0]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                with sqlite3.connect(name) as db:
                    yield from pd.read_sql_query("select * from polar_segments", db, chunksize=20_000, dtype={"neighbourhood_id": "Int64"})

    files = spark.createDataFrame([(n,) for n in names], "path string").repartition(len(names))
    rows = files.mapInPandas(load, "dem_id long, neighbourhood_id long, angle_id int, visible_segments binary")
    return rows, spark.createDataFrame([(meta,)], "json string")


def save_geojson(text: str, directory: str, lon: float, lat: float) -> str:
    """`<directory>/viewsheds/<lon>-<lat>.json`"""
    os.makedirs(f"{directory}/viewsheds", exist_ok=True)
    path = f"{directory}/viewsheds/{lon}-{lat}.json"
    json.loads(text)
    with open(path, "w") as f:
        f.write(text)
    return path
