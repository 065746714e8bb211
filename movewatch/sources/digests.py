"""Stored digests of bars, one row per company and day, from which movements are put together.

A digest holds a day's ends and the moments of its returns (``anomaly.day_digests``). When bars arrive, late ones included, only
the days they fall on are digested again, from those days' folders of the bar table. A movement over a window reads
the digests of its days, and bars only of the days in which some company's window begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movewatch.operators import anomaly
from movewatch.operators.joins import lookup
from movewatch.schemas import MS_PER_DAY
from movewatch.session import materialized
from movewatch.sources import sinks

SCHEMA = (
    "company_id string, day_no long, n long, first_close double, last_close double, last_ts long, last_volume long, volume long, "
    "last_inner double, k long, m double, v double, bad boolean, day date"
)


def open_digests(spark: SparkSession, path: str) -> DataFrame:
    """The digests stored at ``path``, one folder per day; made empty when it is not there yet."""
    spark.createDataFrame([], SCHEMA).write.mode("ignore").partitionBy("day").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def _digested(bars: DataFrame) -> DataFrame:
    made = anomaly.day_digests(bars).withColumnRenamed("_bucket", "day_no")
    return made.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day_no").cast("int")))


def refresh(spark: SparkSession, bars_path: str, path: str, days: DataFrame) -> None:
    """Digest the given days (column ``day``) again. Days without bars keep no row; running it again changes nothing."""
    open_digests(spark, path)
    wanted = [r["day"] for r in days.select("day").distinct().collect()]  # the days of a batch: few by nature
    if wanted:
        bars = sinks.open_table(spark, "bar", bars_path).filter(F.col("day").isin(wanted))
        fresh = _digested(bars.select("company_id", "ts_ms", "close", "volume"))
        fresh.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def append_bars(new: DataFrame, bars_path: str, path: str, order) -> None:
    """Append bars to the stored table and bring the digests of their days up to date."""
    rows = materialized(new, "bars-new")
    sinks.append_table(rows, "bar", bars_path, order)
    refresh(new.sparkSession, bars_path, path, sinks._with_day(rows, "bar").filter(F.col("day").isNotNull()))


def price_movement(spark: SparkSession, bars_path: str, path: str, companies: DataFrame, days: int = 30, digits: int = 4) -> DataFrame:
    """``anomaly.price_movement`` of the stored bars, from their digests.

    A window begins within a day: that day's bars from there on are digested anew, for all companies whose window begins
    on one of these days; every later day comes from its stored digest.
    """
    digests, span = open_digests(spark, path), days * MS_PER_DAY
    starts = digests.groupBy("company_id").agg((F.max("last_ts") - F.lit(span)).alias("start_ms"))
    starts = materialized(starts.withColumn("first_day", F.floor(F.col("start_ms") / F.lit(MS_PER_DAY)).cast("long")), "windows")
    earliest = starts.agg(F.min("first_day")).scalar()
    inside = lookup(digests.filter(F.col("day_no") > earliest), starts, ["company_id"], "day_no").filter(F.col("day_no") > F.col("first_day"))
    opened = [r["day"] for r in starts.select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("first_day").cast("int")).alias("day")).distinct().collect()]
    bars = sinks.open_table(spark, "bar", bars_path)
    bars = bars.filter(F.col("day").isin(opened)) if opened else bars.limit(0)
    begun = lookup(bars.select("company_id", "ts_ms", "close", "volume"), starts, ["company_id"], "ts_ms")
    begun = begun.filter((F.floor(F.col("ts_ms") / F.lit(MS_PER_DAY)) == F.col("first_day")) & (F.col("ts_ms") >= F.col("start_ms")))
    partly = _digested(begun.select("company_id", "ts_ms", "close", "volume"))
    whole = inside.select(partly.columns).unionByName(partly).drop("day").withColumnRenamed("day_no", "_bucket")
    return anomaly.movement_of(whole, companies, digits)
