"""Times the headline queries and prints one line of JSON.

BENCH_SF_DIR: the tables (default sf0.1). BENCH_CPUS: cores of the local master.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sightline.operators import aggregate, kernel, polygons, segments, sight
from sightline.plans import catalogue
from sightline.settings import Settings
from sightline.sources.tables import grid_from_lineitem

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def evaluations(settings: Settings, observers: int) -> int:
    """Slopes worked out: each observer, angle and step."""
    return observers * settings.angles * settings.reach


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "20g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bench = catalogue.BENCH
    dem = grid_from_lineitem(spark, SF_DIR, bench.width).persist()
    dem.count()
    found = kernel.segments(dem, bench)
    queries = {
        "surfaces_kernel": lambda: kernel.surfaces(dem, bench),
        "surfaces_sql": lambda: aggregate.total_surfaces(sight.visibility(dem, bench)),
        "segments": lambda: found,
        "segment_contacts": lambda: segments.contacts(found, bench.angles),
        "viewshed_area": lambda: segments.area(found, bench.angles, bench.scale),
        "viewshed_polygons": lambda: polygons.viewshed_polygons(kernel.segments(grid_from_lineitem(spark, SF_DIR, 48), catalogue.PLAIN), catalogue.PLAIN),
        "flagship": lambda: catalogue.flagship(spark, SF_DIR),
    }
    kernel.surfaces(dem, bench, [0]).write.format("noop").mode("overwrite").save()  # starts the workers
    times = {}
    for name, query in queries.items():
        start = time.perf_counter()
        query().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    work = evaluations(bench, 1716)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "width": bench.width, "evaluations": work, "evaluations_per_sec": {k: round(work / times[k]) for k in ("surfaces_kernel", "surfaces_sql")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
