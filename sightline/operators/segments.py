"""Run-length encoded visibility: making, packing, storing, looking up, and relating segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def polar_segments(visible: DataFrame) -> DataFrame:
    """(dem_id, angle_id, start, distance): runs of visible steps; `start` counts from 0.

    A view whose first step is out of sight also gets an empty run at 0.
    """
    along = W.partitionBy("dem_id", "angle_id").orderBy("k")
    runs = visible.where("visible").withColumn("run", F.col("k") - F.row_number().over(along)).groupBy("dem_id", "angle_id", "run")
    found = runs.agg((F.min("k") - 1).alias("start"), F.count("*").cast("int").alias("distance")).drop("run")
    hidden = visible.where((F.col("k") == 1) & ~F.col("visible")).select("dem_id", "angle_id", F.lit(0).alias("start"), F.lit(0).alias("distance"))
    return found.unionByName(hidden)


def pack(start: Column, distance: Column) -> Column:
    """start above, distance below, 16 bits each, as a long; raises when either does not fit."""
    fits = F.assert_true((start < 65536) & (distance < 65536), F.lit("a segment does not fit 16 bits"))
    return F.when(fits.isNull(), F.shiftleft(start.cast("long"), 16).bitwiseOR(distance.cast("long")))


def unpack_start(packed: Column) -> Column:
    return F.shiftright(packed, 16).cast("int")


def unpack_distance(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFF)).cast("int")


def to_blob(packed: Column) -> Column:
    """An array of packed segments as big-endian 32-bit words."""
    return F.unhex(F.array_join(F.transform(packed, lambda p: F.lpad(F.hex(p), 8, "0")), ""))


def from_blob(blob: Column) -> Column:
    """The packed segments of a blob; raises when its length is no multiple of four."""
    words = F.transform(
        F.sequence(F.lit(0), F.floor(F.octet_length(blob) / 4).cast("int") - 1),
        lambda i: F.conv(F.substring(F.hex(blob), i * 8 + 1, F.lit(8)), 16, 10).cast("long"),
    )
    fits = F.assert_true(F.octet_length(blob) % 4 == 0, F.lit("a segment blob is cut off"))
    return F.when(fits.isNull(), F.when(F.octet_length(blob) == 0, F.array().cast("array<bigint>")).otherwise(words))


def stored(segments: DataFrame, neighbourhood: Column | None = None) -> DataFrame:
    """(dem_id, neighbourhood_id, angle_id, visible_segments): the stored form, one row for each observer and angle."""
    one = F.sort_array(F.collect_list(pack(F.col("start"), F.col("distance"))))
    rows = segments.groupBy("dem_id", "angle_id").agg(to_blob(one).alias("visible_segments"))
    near = F.lit(None).cast("long") if neighbourhood is None else neighbourhood
    return rows.select("dem_id", near.alias("neighbourhood_id"), "angle_id", "visible_segments")


def lookup(rows: DataFrame, dem_id: int | None = None, neighbourhood_id: int | None = None) -> DataFrame:
    """(angle_id, dem_id, visible_segments) of one observer, one row for each angle (the least dem_id's), by angle."""
    wanted = F.col("dem_id") == dem_id if dem_id is not None else F.col("neighbourhood_id") == neighbourhood_id
    first = rows.where(wanted).groupBy("angle_id").agg(F.min_by(F.struct("dem_id", "visible_segments"), "dem_id").alias("row"))
    return first.select("angle_id", "row.dem_id", "row.visible_segments").orderBy("angle_id")


def decoded(rows: DataFrame) -> DataFrame:
    """(dem_id, angle_id, start, distance) from the stored form."""
    each = rows.select("dem_id", "angle_id", F.explode(from_blob(F.col("visible_segments"))).alias("packed"))
    return each.select("dem_id", "angle_id", unpack_start(F.col("packed")).alias("start"), unpack_distance(F.col("packed")).alias("distance"))


def whitelisted(segments: DataFrame, whitelist: DataFrame) -> DataFrame:
    """The segments of the observers in `whitelist` (neighbourhood_id, dem_id)."""
    return segments.join(whitelist.select("dem_id"), "dem_id", "left_semi")


def contacts(segments: DataFrame, angles: int, wrap: bool = False) -> DataFrame:
    """Pairs of segments on neighbouring angles that overlap by more than an end.

    Columns: dem_id, angle_id, start, distance, and next_start, next_distance of
    the segment on the angle after. With `wrap` only the pairs of the last angle
    and the first, otherwise only the others. `segments` is read once: each goes to
    its own angle and to the one before, where the two lists meet; a list has no
    more segments than half the reach.
    """
    run = F.struct("start", "distance")
    places = F.array(F.struct(F.col("angle_id").alias("angle_id"), run.alias("here")), F.struct(((F.col("angle_id") - 1 + angles) % angles).alias("angle_id"), F.lit(None).cast("struct<start:int,distance:int>").alias("here")))
    dealt = segments.where("distance > 0").select("dem_id", run.alias("run"), F.explode(places).alias("at")).select("dem_id", "at.angle_id", "at.here", "run")
    side = F.col("angle_id") == angles - 1 if wrap else F.col("angle_id") < angles - 1
    met = dealt.where(side).groupBy("dem_id", "angle_id").agg(F.collect_list("here").alias("here"), F.collect_list(F.when(F.col("here").isNull(), F.col("run"))).alias("ahead"))

    def touching(h: Column) -> Column:
        overlap = F.filter("ahead", lambda n: (h["start"] < n["start"] + n["distance"]) & (n["start"] < h["start"] + h["distance"]))
        return F.transform(overlap, lambda n: F.struct(h["start"].alias("start"), h["distance"].alias("distance"), n["start"].alias("next_start"), n["distance"].alias("next_distance")))

    return met.select("dem_id", "angle_id", F.inline(F.flatten(F.transform("here", touching))))


def area(segments: DataFrame, angles: int, scale: float) -> DataFrame:
    """(dem_id, ring_sum, area): the area of all sectors; ring_sum is the sum of end squared minus start squared."""
    end = F.col("start") + F.col("distance")
    squares = F.sum((end * end - F.col("start") * F.col("start")).cast("long")).alias("ring_sum")
    sector = F.lit(3.141592653589793 / angles * scale * scale)
    return segments.groupBy("dem_id").agg(squares).withColumn("area", F.col("ring_sum") * sector)


def rings(segments: DataFrame, angles: int, scale: float) -> DataFrame:
    """Each segment as a closed ring of four corners, half an angle step to either side; y points up."""
    half = F.lit(3.141592653589793 / angles)
    middle = F.col("angle_id") * F.lit(2 * 3.141592653589793 / angles)
    near, far = F.col("start") * F.lit(scale), (F.col("start") + F.col("distance")) * F.lit(scale)

    def corner(radius: Column, angle: Column) -> Column:
        return F.struct((radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))

    first = corner(near, middle + half)
    return segments.withColumn("ring", F.array(first, corner(near, middle - half), corner(far, middle - half), corner(far, middle + half), first))
