"""Reductions of visibility: total surfaces, longest lines, the best observer of each neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import neighbourhood_id, tvs_id
from ..settings import DEGREE, Settings

#: Bits of the packed longest line: metres above, angle id below.
PACKED_ANGLE_BITS = 10


def total_surfaces(visible: DataFrame) -> DataFrame:
    """(dem_id, sum_k): the steps at which cells are visible, summed over all angles."""
    return visible.where("visible").groupBy("dem_id").agg(F.sum(F.col("k").cast("long")).alias("sum_k"))


def surface(sum_k: Column, settings: Settings) -> Column:
    """The visible surface that a sum of steps stands for."""
    return sum_k * F.lit(settings.scale * DEGREE)


def longest_lines(visible: DataFrame) -> DataFrame:
    """(dem_id, longest_k, longest_angle): the farthest visible step; of equal ones the smallest angle."""
    best = F.max(F.col("k").cast("long") * (1 << 20) + (F.lit((1 << 20) - 1) - F.col("angle_id"))).alias("best")
    packed = visible.where("visible").groupBy("dem_id").agg(best)
    return packed.select(
        "dem_id", F.shiftright("best", 20).cast("int").alias("longest_k"), (F.lit((1 << 20) - 1) - F.col("best") % (1 << 20)).cast("int").alias("longest_angle")
    )


def pack_line(distance: Column, angle: Column, settings: Settings) -> Column:
    """Whole metres and angle id in 32 bits; raises on angles beyond 10 bits or distances beyond 22."""
    if settings.angles > 1 << PACKED_ANGLE_BITS:
        raise ValueError("packed angles have room for two subdivisions at most")
    fits = F.assert_true(distance < (1 << 22), F.lit("distance does not fit"))
    return F.when(fits.isNull(), F.shiftleft(distance.cast("int"), PACKED_ANGLE_BITS).bitwiseOR(angle.cast("int")))


def unpack_distance(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PACKED_ANGLE_BITS)


def unpack_angle(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PACKED_ANGLE_BITS) - 1))


def dense(values: DataFrame, settings: Settings, columns: list[str]) -> DataFrame:
    """(tvs_id, columns): one row for each cell of the central third, 0 where nothing was computed."""
    grid = values.sparkSession.range(settings.reach**2).select(F.col("id").cast("int").alias("tvs_id"))
    mapped = values.withColumn("tvs_id", tvs_id(F.col("dem_id"), settings.width)).drop("dem_id")
    return grid.join(mapped, "tvs_id", "left").na.fill(0, columns).select("tvs_id", *columns)


def best_in_neighbourhoods(values: DataFrame, settings: Settings, size: int, by: str = "sum_k") -> DataFrame:
    """(neighbourhood_id, dem_id): the observer with the greatest value in each block; of equal ones the least id."""
    block = neighbourhood_id(F.col("dem_id"), settings.width, size)
    least_first = F.max_by("dem_id", F.struct(F.col(by), -F.col("dem_id")))
    return values.groupBy(block.alias("neighbourhood_id")).agg(least_first.alias("dem_id"))
