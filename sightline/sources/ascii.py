"""Rasters of polygons in characters, for looking at and for tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

from ..operators.polygons import _inside


def bresenham(a: tuple[int, int], b: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """The grid points of a line, both ends included."""
    (x, y), (x1, y1) = a, b
    dx, dy = abs(x1 - x), -abs(y1 - y)
    sx, sy = (1 if x < x1 else -1), (1 if y < y1 else -1)
    error = dx + dy
    while True:
        yield x, y
        if (x, y) == (x1, y1):
            return
        twice = 2 * error
        if twice >= dy:
            error += dy
            x += sx
        if twice <= dx:
            error += dx
            y += sy


def raster(polygons: list[dict], width: int, extent: float) -> list[str]:
    """Half-block characters: each row of text shows two rows of cells; a cell is set when its middle is inside."""
    cell = 2 * extent / width

    def inside(x: float, y: float) -> bool:
        return any(_inside((x, y), p["exterior"][:-1]) and not any(_inside((x, y), h[:-1]) for h in p["interiors"]) for p in polygons)

    cells = [[inside((c + 0.5) * cell - extent, extent - (r + 0.5) * cell) for c in range(width)] for r in range(width)]
    cells += [[False] * width] * (width % 2)
    glyphs = {(False, False): " ", (True, False): "▀", (False, True): "▄", (True, True): "█"}
    return ["".join(glyphs[top, low] for top, low in zip(a, b, strict=True)) for a, b in zip(cells[::2], cells[1::2], strict=True)]


def outlines(polygons: list[dict], width: int, at: tuple[float, float] = (0.0, 0.0), zoom: int = 2) -> list[str]:
    """The rings of polygons as lines of blanks on a full ground, `zoom` points to a cell.

    Polygons are in cells, y up, about an observer in column and row `at`. Half-block
    characters show two rows of points each.
    """
    size = width * zoom
    drawn = [[False] * size for _ in range(size + size % 2)]

    def point(p: tuple[float, float]) -> tuple[int, int]:
        return tuple(int(math.copysign(math.floor(abs(v) + 0.5), v)) for v in ((at[0] + p[0]) * zoom, (at[1] - p[1]) * zoom))

    for polygon in polygons:
        for ring in [polygon["exterior"], *polygon["interiors"]]:
            for a, b in zip(ring, ring[1:], strict=False):
                for x, y in bresenham(point(a), point(b)):
                    if 0 <= x < size and 0 <= y < size:
                        drawn[y][x] = True
    glyphs = {(False, False): "█", (False, True): "▀", (True, False): "▄", (True, True): " "}
    return ["".join(glyphs[top, low] for top, low in zip(a, b, strict=True)) for a, b in zip(drawn[::2], drawn[1::2], strict=True)]
