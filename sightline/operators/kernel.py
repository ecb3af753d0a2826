"""Lines of sight in numpy: the same contract as `sight`, for large grids.

A unit of work is an angle and a band of lines. A task turns the grid itself,
fills the band's lines and walks outwards one step at a time for all observers of
the band together, so nothing is shuffled before the work; after it come partial
sums only, one row for each observer and task. Every task has the grid whole, two
bytes a cell, as long as it is no larger than GRID_BYTES. Beyond that lines are
gathered by a shuffle as in `sight`, and go through the same steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import EARTH_DIAMETER, LOWEST_SLOPE, NODATA, Settings
from .sight import line_arrays

#: Packed longest lines: distance in steps above, and below it the angle counted down, so that the larger wins and ties go to the smaller angle.
ANGLE_BITS = 20
#: Grids up to this size are sent to every task (a width of 4096).
GRID_BYTES = 1 << 25
#: Cells of a band, and observers that walk together.
BAND_CELLS = 1 << 18
TOGETHER = 1 << 14


def computable_mask(ids: np.ndarray, width: int) -> np.ndarray:
    reach = width // 3
    radius = (reach - 1) / 2
    y, x = ids // width - reach - radius, ids % width - reach - radius
    return y * y + x * x < radius * radius


def source_cells(angle: int, lines: np.ndarray, settings: Settings) -> np.ndarray:
    """The dem_ids along some lines of the central band, turned by an angle (lines x positions); see `functions.rotation`."""
    reach, last, middle = settings.reach, settings.width - 1, (settings.width - 1) / 2
    degrees = angle / settings.subdivisions
    inverse = 360.0 - degrees if degrees > 0 else 0.0
    quadrant = int(inverse // 90)
    rest = math.radians(inverse - 90 * quadrant)
    alpha, beta = -math.tan(rest / 2), math.sin(rest)
    x, y = np.arange(reach, 3 * reach, dtype=float)[None, :], (lines + reach).astype(float)[:, None]
    x0 = (x, last - y, last - x, y)[quadrant] - middle
    y0 = (y, x, last - y, last - x)[quadrant] - middle

    def rounded(v: np.ndarray) -> np.ndarray:
        return np.sign(v) * np.floor(np.abs(v) + 0.5)

    x1 = x0 + rounded(alpha * y0)
    y1 = y0 + rounded(beta * x1)
    x2 = x1 + rounded(alpha * y1)
    row, column = (np.clip((v + middle).astype(np.int64), 0, last) for v in (y1, x2))
    return row * settings.width + column


def filled(heights: np.ndarray) -> np.ndarray:
    """Along each line the height before for cells without data, 0 at the start; single precision."""
    known = heights != NODATA
    if not known.all():
        at = np.maximum.accumulate(np.where(known, np.arange(heights.shape[1]), -1), axis=1)
        heights = np.where(at >= 0, np.take_along_axis(heights, np.maximum(at, 0), axis=1), 0)
    return heights.astype(np.float32)


def walk(heights: np.ndarray, line: np.ndarray, pos: np.ndarray, settings: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """For each step which of the observers at (line, pos) see the cell so far ahead; the array is used again for the next step."""
    flat = np.ascontiguousarray(heights).ravel()
    at = line * heights.shape[1] + pos
    eye = flat[at] + np.float32(settings.observer_height)
    highest = np.full(len(at), LOWEST_SLOPE, np.float32)
    slope, seen = np.empty_like(highest), np.empty(len(at), bool)
    factor, diameter = np.float32(settings.refraction - 1), np.float32(EARTH_DIAMETER)
    for k in range(1, settings.reach + 1):
        d = np.float32(k * settings.scale)
        at += 1
        np.take(flat, at, out=slope, mode="clip")
        slope -= eye
        slope += (d * d) * factor / diameter
        slope /= d
        np.greater(slope, highest, out=seen)
        np.maximum(slope, highest, out=highest)
        yield k, seen


#: One band: its angle, its cells (lines x positions), and its heights.
Band = tuple[int, np.ndarray, np.ndarray]


def _over_bands(
    dem: DataFrame, settings: Settings, angles: list[int] | None, observers: DataFrame | None, work: Callable[[Iterator[Band], np.ndarray], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Run `work` on the bands of a task and a mask of wanted observers in the central third, where they fall into bands."""
    spark, width, reach = dem.sparkSession, settings.width, settings.reach
    turns = list(range(settings.angles)) if angles is None else list(angles)
    share = spark.sparkContext.broadcast
    wanted = _wanted(observers, settings)
    if wanted is None:  # too many to send: leave the others out afterwards
        return _over_bands(dem, settings, angles, None, work, schema).join(observers.select("dem_id").distinct(), "dem_id", "left_semi")
    mask = share(np.packbits(wanted))

    def unpacked() -> np.ndarray:
        return np.unpackbits(mask.value, count=reach * reach).astype(bool)

    if 2 * width * width > GRID_BYTES:

        def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def bands() -> Iterator[Band]:
                for batch in batches:
                    for angle, ids, elevs in zip(batch["angle_id"].to_pylist(), batch["ids"], batch["elevs"], strict=True):
                        yield angle, ids.values.to_numpy()[None, :], elevs.values.to_numpy().astype(np.float32)[None, :]

            yield from work(bands(), unpacked())

        return line_arrays(dem, settings, angles).mapInArrow(gathered, schema)

    grid = share(_grid(dem, settings))
    height = max(1, min(reach, BAND_CELLS // (2 * reach)))
    per_angle = -(-reach // height)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bands() -> Iterator[Band]:
            for batch in batches:
                for unit in batch.column(0).to_pylist():
                    angle, first = turns[unit // per_angle], unit % per_angle * height
                    cells = source_cells(angle, np.arange(first, min(first + height, reach)), settings)
                    yield angle, cells, filled(grid.value[cells])

        yield from work(bands(), unpacked())

    return spark.range(len(turns) * per_angle).mapInArrow(turned, schema)


def _grid(dem: DataFrame, settings: Settings) -> np.ndarray:
    """The elevations in order of dem_id; NODATA where the table has none. At most GRID_BYTES."""
    grid = np.full(settings.width**2, NODATA, np.int16)
    cells = dem.where("dem_id is not null and elev is not null").select("dem_id", F.col("elev").cast("short").alias("elev")).toArrow()
    grid[cells["dem_id"].to_numpy()] = cells["elev"].to_numpy()
    return grid


def _wanted(observers: DataFrame | None, settings: Settings) -> np.ndarray | None:
    """Which cells of the central third to work for; None when naming them would take more than GRID_BYTES."""
    width, reach = settings.width, settings.reach
    tvs = np.arange(reach * reach)
    mask = computable_mask((tvs // reach + reach) * width + tvs % reach + reach, width)
    if observers is None:
        return mask
    if 8 * reach * reach > GRID_BYTES:
        return None
    inner = observers.where(f"dem_id div {width} between {reach} and {2 * reach - 1} and dem_id % {width} between {reach} and {2 * reach - 1}")
    ids = inner.select("dem_id").distinct().toArrow()["dem_id"].to_numpy().astype(np.int64)
    named = np.zeros(reach * reach, bool)
    named[(ids // width - reach) * reach + ids % width - reach] = True
    return mask & named


def _observers(cells: np.ndarray, wanted: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line, pos, tvs) of the wanted observers of a band, TOGETHER at a time."""
    reach, width = settings.reach, settings.width
    y, x = cells[:, :reach] // width - reach, cells[:, :reach] % width - reach
    inside = (y >= 0) & (y < reach) & (x >= 0) & (x < reach)
    tvs = np.where(inside, y * reach + x, 0)
    line, pos = np.nonzero(inside & wanted[tvs])
    for k in range(0, len(line), TOGETHER):
        some = slice(k, k + TOGETHER)
        yield line[some], pos[some], tvs[line[some], pos[some]]


def _dem_id(tvs: np.ndarray, settings: Settings) -> np.ndarray:
    return (tvs // settings.reach + settings.reach) * settings.width + tvs % settings.reach + settings.reach


def surfaces(dem: DataFrame, settings: Settings, angles: list[int] | None = None, observers: DataFrame | None = None) -> DataFrame:
    """(dem_id, sum_k, longest_k, longest_angle) of every computable observer, over all angles.

    observers: a table whose dem_id names the observers to work for; the work is in proportion to them.
    """
    turns, third = settings.angles, settings.reach**2

    def summed(bands: Iterator[Band], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        total, best, met = np.zeros(third, np.int64), np.zeros(third, np.int64), np.zeros(third, bool)
        for angle, cells, heights in bands:
            for line, pos, tvs in _observers(cells, wanted, settings):
                sums, last = np.zeros(len(tvs), np.int32), np.zeros(len(tvs), np.int32)
                for k, seen in walk(heights, line, pos, settings):
                    sums += seen * np.int32(k)
                    np.copyto(last, k, where=seen)
                met[tvs] = True
                np.add.at(total, tvs, sums)
                np.maximum.at(best, tvs, last.astype(np.int64) << ANGLE_BITS | (turns - 1 - angle))
        (at,) = np.nonzero(met)
        if len(at):
            columns = [pa.array(_dem_id(at, settings)), pa.array(total[at]), pa.array(best[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["dem_id", "sum_k", "best"])

    partial = _over_bands(dem, settings, angles, observers, summed, "dem_id long, sum_k long, best long")
    total = partial.groupBy("dem_id").agg(F.sum("sum_k").alias("sum_k"), F.max("best").alias("best"))
    low = (1 << ANGLE_BITS) - 1
    return total.select(
        "dem_id", "sum_k", F.shiftright("best", ANGLE_BITS).cast("int").alias("longest_k"),
        F.when(F.col("best") > low, F.lit(turns - 1) - F.col("best").bitwiseAND(F.lit(low))).otherwise(0).cast("int").alias("longest_angle"),
    )


def segments(dem: DataFrame, settings: Settings, angles: list[int] | None = None, observers: DataFrame | None = None) -> DataFrame:
    """(dem_id, angle_id, start, distance): the runs of visible cells of every observer and angle; see `operators.segments`.

    observers: as in `surfaces`.
    """
    reach = settings.reach

    def cut(bands: Iterator[Band], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        for angle, cells, heights in bands:
            for line, pos, tvs in _observers(cells, wanted, settings):
                ids = _dem_id(tvs, settings)
                start, before = np.zeros(len(ids), np.int32), np.zeros(len(ids), bool)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

                def ended(who: np.ndarray, end: int) -> None:
                    out.append((ids[who], start[who], end - start[who]))

                for k, seen in walk(heights, line, pos, settings):
                    if k == 1:  # a first cell out of sight is an empty run at 0
                        ended(np.flatnonzero(~seen), 0)
                    turn = seen != before
                    if turn.any():
                        ended(np.flatnonzero(turn & before), k - 1)
                        start[turn & seen] = k - 1
                    np.copyto(before, seen)
                ended(np.flatnonzero(before), reach)
                who, first, long = (np.concatenate(c) for c in zip(*out, strict=True))
                columns = [pa.array(who), pa.array(np.full(len(who), angle, np.int32)), pa.array(first.astype(np.int32)), pa.array(long.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["dem_id", "angle_id", "start", "distance"])

    return _over_bands(dem, settings, angles, observers, cut, "dem_id long, angle_id int, start int, distance int")
