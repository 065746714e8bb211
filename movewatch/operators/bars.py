"""Price bars: windows of bars, returns, series and per-company aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movewatch.functions.scalar import ms_to_s, ms_to_ts, ratio
from movewatch.operators.ordered import lag_by_bucket, positions, time_bucket, top_n
from movewatch.schemas import MS_PER_DAY, RANGE_DAYS

# Bars are unique on (company_id, ts_ms), so a (company, day) bucket holds at most
# one bar per distinct time stamp of that day, whatever the company's share is.
DAY_BUCKET = MS_PER_DAY


def last_n(bars: DataFrame, n: int = 30, rank: str | None = None) -> DataFrame:
    """The newest n bars of each company."""
    return top_n(bars, ["company_id"], [F.desc("ts_ms")], n, rank)


def with_returns(bars: DataFrame, bucket_ms: int = DAY_BUCKET) -> DataFrame:
    """Adds prev_close and the simple return; NULL return after a close of 0.

    Restrict the bars to the wanted window first: the lag is taken inside it.
    """
    lagged = lag_by_bucket(
        bars, ["company_id"], "ts_ms", "close", time_bucket("ts_ms", bucket_ms), "prev_close"
    )
    return lagged.withColumn("ret", ratio(F.col("close"), F.col("prev_close")) - 1)


def anchors(bars: DataFrame) -> DataFrame:
    """Newest bar time per company."""
    return bars.groupBy("company_id").agg(F.max("ts_ms").alias("anchor_ms"))


def price_bounds(bars: DataFrame) -> DataFrame:
    """First and last bar time per company."""
    return bars.groupBy("company_id").agg(
        F.min("ts_ms").alias("from_ms"), F.max("ts_ms").alias("to_ms")
    )


def latest_price(bars: DataFrame) -> DataFrame:
    return bars.groupBy("company_id").agg(F.max_by("close", "ts_ms").alias("latest_close"))


def day_change(bars: DataFrame) -> DataFrame:
    """Percent change from the first to the last close of the given bars.

    NULL with fewer than two bars or a first close of 0; ``positive`` means pct >= 0.
    """
    ends = bars.groupBy("company_id").agg(
        F.min_by("close", "ts_ms").alias("_first"),
        F.max_by("close", "ts_ms").alias("_last"),
        F.count(F.lit(1)).alias("n_bars"),
    )
    pct = F.when(
        F.col("n_bars") >= 2, ratio(F.col("_last") - F.col("_first"), F.col("_first")) * 100
    )
    return ends.select("company_id", "n_bars", pct.alias("pct"), (pct >= 0).alias("positive"))


def range_start(range_name: str, as_of_ms: int) -> int:
    return as_of_ms - RANGE_DAYS[range_name] * MS_PER_DAY


def in_range(bars: DataFrame, range_name: str, as_of_ms: int) -> DataFrame:
    """Bars of the last 1, 7, 30 or 90 days; the filter reaches the scan."""
    return bars.filter(F.col("ts_ms") >= F.lit(range_start(range_name, as_of_ms)))


def price_range(bars: DataFrame, range_name: str, as_of_ms: int) -> DataFrame:
    """As ``in_range``, ascending in time. The sort ranges over (company, time), so a
    company with many bars is spread over tasks."""
    return in_range(bars, range_name, as_of_ms).orderBy("company_id", "ts_ms")


def chart_series(bars: DataFrame, kind: str = "candlestick") -> DataFrame:
    """Candles (time, open, high, low, close) or a line (time, value), time in seconds."""
    time = ms_to_s("ts_ms").alias("time")
    if kind == "candlestick":
        return bars.select("company_id", time, "open", "high", "low", "close")
    if kind == "line":
        return bars.select("company_id", time, F.col("close").alias("value"))
    raise ValueError(f"unknown chart kind {kind!r}")


def series(bars: DataFrame, chunk: int = 1000, bucket_ms: int = DAY_BUCKET) -> DataFrame:
    """Ordered arrays of (timestamp, close, volume), ``chunk`` bars to a row.

    A company with at most ``chunk`` bars gets its whole series in chunk 0; a longer
    one continues in chunk 1, 2, ... so no row or task has to hold an unbounded array.
    """
    placed = positions(bars, ["company_id"], ["ts_ms"], time_bucket("ts_ms", bucket_ms))
    point = F.struct(F.col("ts_ms").alias("timestamp"), "close", "volume")
    return (
        placed.withColumn("chunk_no", F.floor(F.col("position") / F.lit(chunk)).cast("long"))
        .groupBy("company_id", "chunk_no")
        .agg(F.sort_array(F.collect_list(point)).alias("series"))
    )


def resample_daily(bars: DataFrame) -> DataFrame:
    """Daily bars (UTC days): first open, highest high, lowest low, last close, volume sum."""
    day = F.floor(F.col("ts_ms") / F.lit(MS_PER_DAY)).cast("long") * F.lit(MS_PER_DAY)
    return bars.groupBy("company_id", day.alias("day_ms")).agg(
        F.min_by("open", "ts_ms").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts_ms").alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("day_ms", "ts_ms")


def recent_weekdays(end: Column, n: int, close_hour: int = 20) -> Column:
    """Array of the n newest weekdays up to ``end`` (a date), ascending, at close hour UTC."""
    back = F.sequence(F.date_sub(end, 2 * n + 4), end)
    weekdays = F.filter(back, lambda d: F.weekday(d) < 5)
    newest = F.slice(weekdays, F.size(weekdays) - F.lit(n - 1), n)
    return F.transform(
        newest, lambda d: F.unix_millis(d.cast("timestamp")) + F.lit(close_hour * 3_600_000)
    )


def trading_days(spark: SparkSession, end: str, n: int, close_hour: int = 20) -> DataFrame:
    """The n newest weekdays up to and including ``end``, one row each, ascending."""
    days = recent_weekdays(F.lit(end).cast("date"), n, close_hour)
    return spark.range(1).select(F.explode(days).alias("ts_ms"))


def company_sessions(anchor: DataFrame, n: int, close_hour: int = 20) -> DataFrame:
    """``trading_days`` ending on each company's anchor date."""
    end = F.to_date(ms_to_ts("anchor_ms"))
    return anchor.select("company_id", F.posexplode(recent_weekdays(end, n, close_hour)).alias("session_no", "ts_ms"))
