"""The `dem` data source: a raster file as rows (dem_id, elev), read in parallel by bands of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..settings import Settings
from . import tiff

BAND_CELLS = 1 << 21


class Band(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class DemReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.header = path, tiff.read_header(path)

    def partitions(self) -> list[Band]:
        high = self.header.block[1] if self.header.block[1] < self.header.height else 1
        rows = max(1, BAND_CELLS // self.header.width // high) * high  # whole strips or tiles
        return [Band(a, min(a + rows, self.header.height)) for a in range(0, self.header.height, rows)]

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        width = self.header.width
        for row, values in enumerate(tiff.read_rows(self.path, self.header, partition.start, partition.stop), partition.start):
            ids = np.arange(row * width, (row + 1) * width, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tiff.elevations(values))], names=["dem_id", "elev"])


class DemSource(DataSource):
    """Option `path`: a file all executors can open."""

    @classmethod
    def name(cls) -> str:
        return "dem"

    def schema(self) -> str:
        return "dem_id long, elev short"

    def reader(self, schema) -> DemReader:
        return DemReader(self.options["path"])


def read_dem(spark: SparkSession, path: str, **settings) -> tuple[DataFrame, Settings]:
    """The elevations of a raster file, and the settings that follow from its header."""
    spark.dataSource.register(DemSource)
    header = tiff.read_header(path)
    made = Settings(header.width, scale=header.scale, centre=header.lonlat(), **settings)
    return spark.read.format("dem").option("path", path).load(), made


def read_heatmap(spark: SparkSession, path: str) -> DataFrame:
    """(tvs_id, value) of an existing heatmap of the central third, as a source of neighbourhood bests."""
    header = tiff.read_header(path)
    high = header.block[1]
    ids = spark.range(0, header.height, high).select(F.col("id").cast("int").alias("row"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                for row, values in enumerate(tiff.read_rows(path, header, first, min(first + high, header.height)), first):
                    at = np.arange(row * header.width, (row + 1) * header.width, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values.astype(np.float32))], names=["tvs_id", "value"])

    return ids.mapInArrow(rows, "tvs_id long, value float")


def grid_from_values(spark: SparkSession, values: list[int]) -> DataFrame:
    """(dem_id, elev) of a list in row-major order, for tests."""
    return spark.createDataFrame(list(enumerate(values)), "dem_id long, elev short")
