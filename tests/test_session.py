"""Intermediate tables: what they leave behind, and the caller's settings."""

import time

import pytest
from pyspark.sql import functions as F

from movewatch.session import SHUFFLE_CLEANUP, materialized


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
    count = 0
    while files.hasNext():
        count += files.next().getName().startswith("shuffle_")
    return count


def wide(spark):
    rows = spark.range(20_000).select((F.col("id") % 97).alias("k"), "id")
    return rows.groupBy("k").agg(F.count("*").alias("n")).join(rows.repartition(3, "k"), "k")


def test_shuffle_files_go_with_the_write(spark):
    before = shuffle_files(spark)
    table = materialized(wide(spark), "test")
    until = time.time() + 20
    while shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert table.count() == 20_000


@pytest.mark.parametrize("own", [None, "true", "false"])
def test_setting_is_put_back(spark, own):
    if own is not None:
        spark.conf.set(SHUFFLE_CLEANUP, own)
    try:
        materialized(wide(spark), "test")
        assert spark.conf.get(SHUFFLE_CLEANUP, None) == own
        with pytest.raises(Exception):
            materialized(spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x")), "test")
        assert spark.conf.get(SHUFFLE_CLEANUP, None) == own
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP)


def test_tables_of_tables(spark):
    """A table made from others outlives the shuffle files of all of them."""
    once = materialized(wide(spark), "test")
    twice = materialized(once.groupBy("k").agg(F.sum("id").alias("s")), "test")
    assert twice.join(once, "k").count() == 20_000
