"""Lines of sight as DataFrame operations: the definition of what is visible.

Everything from the elevation gather on is keyed by (angle_id, line): one
exchange, after which filling, pairing observers with what they look at, and
the running maximum all stay within a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import is_computable
from ..functions.rotation import rotated_cells
from ..settings import EARTH_DIAMETER, LOWEST_SLOPE, NODATA, Settings

#: Grids up to this many cells (10 bytes each) are broadcast in the gather.
BROADCAST_CELLS = 1 << 20


def step_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """(k, d, adj): distance and curvature of each step, single precision."""
    k = spark.range(1, settings.reach + 1).select(F.col("id").cast("int").alias("k"))
    d = k.withColumn("d", (F.col("k") * F.lit(settings.scale)).cast("float"))
    factor = F.lit(settings.refraction - 1).cast("float")
    return d.withColumn("adj", ((F.col("d") * F.col("d")) * factor / F.lit(EARTH_DIAMETER).cast("float")).cast("float"))


def gather(cells: DataFrame, dem: DataFrame, settings: Settings) -> DataFrame:
    """Give every rotated cell its elevation; null where the grid has none."""
    known = dem.select("dem_id", F.when(F.col("elev") != NODATA, F.col("elev")).cast("int").alias("elev"))
    small = settings.width**2 <= BROADCAST_CELLS
    return cells.join(F.broadcast(known) if small else known, "dem_id", "left")


def lines(dem: DataFrame, settings: Settings, angles: list[int] | None = None) -> DataFrame:
    """(angle_id, line, pos, dem_id, elev): elevations along each line, gaps filled from the cells before, 0 at the start."""
    cells = gather(rotated_cells(dem.sparkSession, settings, angles), dem, settings)
    along = W.partitionBy("angle_id", "line").orderBy("pos")
    return cells.withColumn("elev", F.coalesce(F.last("elev", ignorenulls=True).over(along), F.lit(0)))


def line_arrays(dem: DataFrame, settings: Settings, angles: list[int] | None = None) -> DataFrame:
    """(angle_id, line, ids, elevs): each filled line as two arrays in order of position."""
    packed = lines(dem, settings, angles).groupBy("angle_id", "line").agg(F.sort_array(F.collect_list(F.struct("pos", "dem_id", "elev"))).alias("cells"))
    return packed.select("angle_id", "line", F.col("cells.dem_id").alias("ids"), F.col("cells.elev").alias("elevs"))


def slope(elev: Column, observer: Column, adj: Column, d: Column, height: float) -> Column:
    """The slope from an observer to a cell d away; every step rounded to single precision."""
    eye = (observer.cast("float") + F.lit(height).cast("float")).cast("float")
    rise = ((elev.cast("float") - eye).cast("float") + adj).cast("float")
    return (rise / d).cast("float")


def slopes(filled: DataFrame, settings: Settings, observers: Column | None = None) -> DataFrame:
    """(dem_id, angle_id, line, pos, k, d, slope): every computable observer with each cell ahead of it.

    Each line is gathered into one array, so an observer's view is a slice of it
    and needs no join. `observers` is a further condition on dem_id.
    """
    steps = step_table(filled.sparkSession, settings)
    reach = settings.reach
    packed = filled.groupBy("angle_id", "line").agg(F.sort_array(F.collect_list(F.struct("pos", "dem_id", "elev"))).alias("cells"))
    pos = F.explode(F.sequence(F.lit(0), F.lit(reach - 1))).alias("pos")
    povs = packed.select("angle_id", "line", "cells", pos)
    povs = povs.withColumns({"dem_id": F.col("cells")[F.col("pos")]["dem_id"], "pov": F.col("cells")[F.col("pos")]["elev"]})
    seen_from = povs.where(is_computable(F.col("dem_id"), settings.width) & (F.lit(True) if observers is None else observers))
    ahead = F.posexplode(F.slice(F.transform("cells", lambda c: c["elev"]), F.col("pos") + 2, F.lit(reach))).alias("step", "elev")
    views = seen_from.select("dem_id", "angle_id", "line", "pos", "pov", ahead).withColumn("k", F.col("step") + 1)
    views = views.join(F.broadcast(steps), "k")  # as many rows as the reach
    made = slope(F.col("elev"), F.col("pov"), F.col("adj"), F.col("d"), settings.observer_height)
    return views.select("dem_id", "angle_id", "line", "pos", "k", "d", made.alias("slope"))


def visibility(dem: DataFrame, settings: Settings, angles: list[int] | None = None, observers: Column | None = None) -> DataFrame:
    """(dem_id, angle_id, k, d, visible): a cell is visible if its slope beats all slopes before it."""
    views = slopes(lines(dem, settings, angles), settings, observers)
    before = W.partitionBy("angle_id", "line", "pos").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    highest = F.greatest(F.coalesce(F.max("slope").over(before), F.lit(LOWEST_SLOPE).cast("float")), F.lit(LOWEST_SLOPE).cast("float"))
    return views.withColumn("visible", F.col("slope") > highest).select("dem_id", "angle_id", "k", "d", "visible")
