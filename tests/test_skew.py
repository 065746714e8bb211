"""A company that holds a third of all rows is split, not given to one task."""

import pytest
from pyspark.sql import functions as F

from conftest import DAY, plan_of
from movewatch.operators import retrieval
from movewatch.operators.anomaly import price_movement
from movewatch.operators.bars import anchors
from movewatch.schemas import COMPANY

TIGHT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def tight(spark):
    """Thresholds small enough for test data to count as large."""
    old = {k: spark.conf.get(k, None) for k in TIGHT}
    for k, v in TIGHT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _hot(spark, n=120_000):
    company = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("c"), (F.col("id") % 500).cast("string")))
    return spark.range(0, n, 1, 8).withColumn("company_id", company)


def _final(df):
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def test_hot_news_join_is_split(tight):
    items = _hot(tight).select(
        F.col("id").cast("string").alias("id"), "company_id", F.sha2(F.col("id").cast("string"), 512).alias("headline"),
        F.lit("s").alias("summary"), F.lit("w").alias("source"), F.col("id").alias("published_at"),
    )
    bars = _hot(tight).select("company_id", F.col("id").alias("ts_ms"))
    out = retrieval.news_window(items, anchors(bars), 7)
    assert "skew=true" in _final(out)
    assert out.count() == 120_000


def test_hot_movement_is_cut_by_day(tight):
    bars = _hot(tight).select(
        "company_id", (F.col("id") * (40 * DAY // 120_000)).alias("ts_ms"), (F.col("id") % 97 + 1).cast("double").alias("close"),
        F.lit(5).cast("long").alias("volume"),
    )
    names = bars.select("company_id").distinct().select("company_id", F.col("company_id").alias("name"), F.lit("S").alias("sector"))
    plan = _final(price_movement(bars, tight.createDataFrame(names.collect(), COMPANY)))
    assert "hashpartitioning(company_id" in plan and "_bucket" in plan
    # the window over bars is by company and day; the one by company runs on the digests
    bars_window = [line for line in plan.splitlines() if "Window [lag(close" in line]
    assert bars_window and all("_bucket" in line for line in bars_window)


def test_no_window_looks_forward_without_end(spark):
    markers = spark.createDataFrame([("A", 1, "m", "news", 0)], "company_id string, time long, signal_id string, type string, type_rank int")
    points = spark.createDataFrame([("A", 2)], "company_id string, time long")
    assert "unboundedfollowing" not in plan_of(retrieval.nearest_signal(points, markers))
