"""Rotation of the grid by whole quarters and three rounded shears."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import Settings
from .grid import away_from_zero


def angle_table(spark: SparkSession, settings: Settings, angles: list[int] | None = None) -> DataFrame:
    """(angle_id, inverse, quadrant, alpha, beta): one row per angle, with the shear factors of its rotation."""
    ids = spark.createDataFrame([(a,) for a in angles], "angle_id int") if angles is not None else spark.range(settings.angles).select(F.col("id").cast("int").alias("angle_id"))
    degrees = F.col("angle_id") / F.lit(float(settings.subdivisions))
    inverse = F.when(degrees > 0, 360.0 - degrees).otherwise(0.0)
    turned = ids.withColumn("inverse", inverse).withColumn("quadrant", F.floor(F.col("inverse") / 90).cast("int"))
    rest = F.radians(F.col("inverse") - 90 * F.col("quadrant"))
    return turned.withColumns({"alpha": -F.tan(rest / 2), "beta": F.sin(rest)})


def source_cell(x: Column, y: Column, width: int) -> Column:
    """The dem_id that position (x, y) of the rotated grid shows; wants quadrant, alpha and beta in the row."""
    last, middle = F.lit(width - 1), F.lit((width - 1) / 2)
    q = F.col("quadrant")
    x0 = F.when(q == 0, x).when(q == 1, last - y).when(q == 2, last - x).otherwise(y) - middle
    y0 = F.when(q == 0, y).when(q == 1, x).when(q == 2, last - y).otherwise(last - x) - middle
    x1 = x0 + away_from_zero(F.col("alpha") * y0)
    y1 = y0 + away_from_zero(F.col("beta") * x1)
    x2 = x1 + away_from_zero(F.col("alpha") * y1)

    def cell(v: Column) -> Column:
        return F.least(F.greatest((v + middle).cast("int"), F.lit(0)), last)

    return (cell(y1) * width + cell(x2)).cast("long")


def rotated_cells(spark: SparkSession, settings: Settings, angles: list[int] | None = None) -> DataFrame:
    """(angle_id, line, pos, dem_id): the central band of every rotation, `line` from its first row and `pos` from its first observer."""
    reach = settings.reach
    # A pure generator: range splits over the tasks by itself.
    table = F.broadcast(angle_table(spark, settings, angles))
    cells = spark.range(2 * reach * reach).select(
        F.floor(F.col("id") / (2 * reach)).cast("int").alias("line"), (F.col("id") % (2 * reach)).cast("int").alias("pos")
    )
    return cells.crossJoin(table).select("angle_id", "line", "pos", source_cell(F.col("pos") + reach, F.col("line") + reach, settings.width).alias("dem_id"))
