"""The descriptor of a run, kept as one JSON row beside its segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import Settings

FIELDS = "width int, scale double, max_line_of_sight int, centre struct<lon:double,lat:double>, neighbourhood_size int, angle_subdivisions int"


def metadata_row(spark: SparkSession, settings: Settings) -> DataFrame:
    """(json): one row."""
    row = (settings.width, settings.scale, settings.reach, settings.centre, settings.neighbourhood, settings.subdivisions)
    return spark.createDataFrame([row], FIELDS).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def read_metadata(rows: DataFrame) -> DataFrame:
    """The fields of the first row, flat."""
    m = rows.limit(1).select(F.from_json("json", FIELDS).alias("m"))
    return m.select("m.width", "m.scale", "m.max_line_of_sight", F.col("m.centre.lon").alias("centre_lon"), F.col("m.centre.lat").alias("centre_lat"), "m.neighbourhood_size", "m.angle_subdivisions")


def settings_of(rows: DataFrame, **changed) -> Settings:
    m = read_metadata(rows).first()
    return Settings(m["width"], scale=m["scale"], subdivisions=m["angle_subdivisions"], neighbourhood=m["neighbourhood_size"], centre=(m["centre_lon"], m["centre_lat"]), **changed)
