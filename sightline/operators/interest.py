"""Area of interest: which observers are worth computing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.grid import column_of, row_of


def inside(dem_id: Column, width: int, polygon: list[tuple[float, float]]) -> Column:
    """Strictly inside a polygon given in (column, row) grid coordinates; on its border is outside. No polygon holds everything."""
    if not polygon:
        return F.lit(True)
    x, y = column_of(dem_id, width).cast("double"), row_of(dem_id, width).cast("double")
    crossings, border = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if (x1, y1) == (x2, y2):
            continue
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        border |= (F.abs(cross) < 1e-9) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings += F.when(spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return (crossings % 2 == 1) & ~border
