"""Scores of all past bars and findings over time."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from conftest import DAY, bar, by_key
from movewatch import schemas
from movewatch.operators.anomaly import backfill_scores, score_watchlist
from movewatch.operators.findings import company_trend


def same(got, want):
    assert set(got) == set(want)
    for k, row in want.items():
        for column, value in row.asDict().items():
            assert got[k][column] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (k, column)


def test_newest_backfilled_score_is_the_scan(spark, bars):
    history = backfill_scores(bars)
    newest = history.join(bars.groupBy("company_id").agg(F.max("ts_ms").alias("anchor_ms")), ["company_id", "anchor_ms"])
    same(by_key(newest, "company_id"), by_key(score_watchlist(bars), "company_id"))


@pytest.mark.parametrize("block", [5, 7, 1024])
def test_every_bar_is_scored_as_if_it_were_the_newest(spark, block):
    closes = [100.0, 101.0, 0.0, 99.0, None, 102.0, 103.0, 104.0, float("nan"), 105.0, 104.0, 103.0, 104.0, 90.0, 91.0, 92.0, 93.0, 94.0]
    rows = [bar("A", d * DAY // 3, c, 1000 + 7 * d if d != 11 else 9000) for d, c in enumerate(closes)]
    rows += [bar("B", d * DAY * 5, 50.0 + d % 3, 10 + d) for d in range(12)] + [bar("C", 0, 1.0, 1)]
    df = spark.createDataFrame(rows, schemas.BAR)
    got = backfill_scores(df, n=5, min_bars=2, block=block)
    found = {(r["company_id"], r["anchor_ms"]): r for r in got.collect()}
    want = {}
    for t in sorted({r[1] for r in rows}):
        upto = score_watchlist(df.filter(F.col("ts_ms") <= t), n=5, min_bars=2)
        want |= {(r["company_id"], t): r for r in upto.filter(F.col("anchor_ms") == t).collect()}
    same(found, want)
    assert all(c != "C" for c, _ in found)


def test_a_hot_company_is_spread_over_blocks(spark):
    company = F.when(F.col("id") < 0, "x").otherwise("hot")
    df = spark.range(20_000).select(company.alias("company_id"), (F.col("id") * 1000).alias("ts_ms"), (100 + F.col("id") % 7).cast("double").alias("close"), F.lit(5).cast("long").alias("volume"))
    scores = backfill_scores(df, block=500)
    assert scores.count() == 20_000 - 29
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    keys = {re.sub(r"#\d+L?", "", k) for k in re.findall(r"windowspecdefinition\((.*?) ASC", plan)}
    # by company, bucket and time; by company and bucket, over the buckets' totals; by company, block and place
    assert keys == {"company_id, _bucket, ts_ms", "company_id, _bucket", "company_id, _block, position"}
    with pytest.raises(ValueError):
        backfill_scores(df, block=10)
    assert backfill_scores(df.limit(0)).count() == 0


def at(day):
    return int(dt.datetime(2024, 1, day, 12, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_trend_fills_empty_periods_and_carries_confidence(spark):
    rows = [("A", at(2), "news", "high"), ("A", at(3), "sector", "low"), ("A", at(23), "news", "medium"), ("B", at(9), "unexplained", None), (None, at(9), "news", "low"), ("C", None, "news", "low")]
    df = spark.createDataFrame(rows, "company_id string, created_at long, primary_driver string, confidence string")
    got = [tuple(r) for r in company_trend(df).orderBy("company_id", "period").collect()]
    day = lambda d: dt.date(2024, 1, d)
    assert got == [
        ("A", day(1), 2, 1, 0, 1, 0, 2, 2.0, 2.0, None),
        ("A", day(8), 0, 0, 0, 0, 0, 2, None, 2.0, None),
        ("A", day(15), 0, 0, 0, 0, 0, 2, None, 2.0, None),
        ("A", day(22), 1, 1, 0, 0, 0, 3, 2.0, 2.0, 0.0),
        ("B", day(8), 1, 0, 0, 0, 1, 1, None, None, None),
    ]
    months = [tuple(r)[:3] for r in company_trend(df, "month").orderBy("company_id").collect()]
    assert months == [("A", day(1), 3), ("B", day(1), 1)]
    assert company_trend(df.limit(0)).count() == 0
