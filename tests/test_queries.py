"""Every terrain query against its SQL, on the smallest tables."""

import pytest

from sightline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(name, compare):
    assert len(compare(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name]))


def test_entry_point_lists_them(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 88


@pytest.mark.parametrize("name", ["rotated_cells", "line_elevations", "line_filled", "slopes", "visibility_bitmap", "segment_rings"])
def test_whole_circle_is_registered(spark, name):
    whole = catalogue.QUERIES[f"{name}_all_angles"](spark, "/root/testdata/sf0.001")
    assert [r[0] for r in whole.select("angle_id").distinct().orderBy("angle_id").collect()] == list(range(360))
