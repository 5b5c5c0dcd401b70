"""Intermediate tables: written, read back, and removed when they may go."""

from pathlib import Path

from panelspark.llm import common
from panelspark.llm.graph import components


def folder(df):
    return Path(df.saved_at.removeprefix("file://"))


def test_saved_tables_can_be_removed(spark):
    one, two = (common.saved(spark.range(3), name) for name in ("one", "two"))
    assert folder(one).exists() and one.count() == 3
    common.dropped(one)
    assert not folder(one).exists() and folder(two).exists()
    common.clear(spark)
    assert not folder(two).exists() and not common._WRITTEN


def test_components_leave_one_table(spark):
    before = len(common._WRITTEN)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert len(common._WRITTEN) == before + 1
