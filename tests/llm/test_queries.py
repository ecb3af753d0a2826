"""Every query of the package: against its SQL where there is one, and over all rows of its table."""

import pytest

from sightline.llm import catalogue

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(name, compare):
    for sf in ("sf0.001", "sf0.01"):
        compare(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", ["op1_fingerprints", "op3_language", "op6_shards", "op7_neardup", "op9_decontam", "op10_quality"])
def test_one_row_for_each_document(spark, name):
    ids = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id")
    got = catalogue.QUERIES[name](spark, f"{DATA}/sf0.001").select("doc_id")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in ids.collect())


def test_every_operator_has_one_query():
    import __spark_entry__

    numbers = [int(n.split("_")[0][2:]) for n in catalogue.QUERIES]
    assert numbers == list(range(1, 11)) and {*catalogue.QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_package():
    import pathlib
    import re

    root = pathlib.Path(catalogue.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
