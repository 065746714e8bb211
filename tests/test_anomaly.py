import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import DAY, SCORED, bar, by_key, plan_of, rows_of, statistics
from movewatch import schemas
from movewatch.operators import anomaly
from movewatch.operators.bars import (
    anchors, chart_series, day_change, last_n, latest_price, price_range, resample_daily, series, trading_days, with_returns,
)


def test_scores_of_the_fixture(bars):
    got = by_key(anomaly.score_watchlist(bars), "company_id")
    assert set(got) == set(SCORED) | {"FLAT", "NULC"}  # SHRT has 29 bars
    for company, (_, close, _, ret, z, vol, flagged) in SCORED.items():
        row = got[company]
        assert row["latest_close"] == close
        assert row["latest_return"] == pytest.approx(ret)
        assert row["z_score"] == pytest.approx(z, abs=1e-6)
        assert row["volume_ratio"] == pytest.approx(vol, abs=1e-6)
        assert row["flagged"] is flagged
        assert row["status"] == "ok" and row["n_bars"] == 30


def test_flat_and_bad_companies(bars):
    got = by_key(anomaly.score_watchlist(bars), "company_id")
    assert (got["FLAT"]["z_score"], got["FLAT"]["volume_ratio"], got["FLAT"]["direction"]) == (0.0, 0.0, "down")
    assert not got["FLAT"]["flagged"]
    bad = got["NULC"]
    assert bad["status"] == "bad_data" and bad["z_score"] is None and bad["flagged"] is False


def test_zero_previous_close_is_bad_data(spark):
    rows = [bar("Z", i * DAY, 0.0 if i == 3 else 10.0 + i, 5) for i in range(30)]
    last_zero = [bar("L", i * DAY, 0.0 if i == 29 else 10.0 + i, 5) for i in range(30)]
    got = by_key(anomaly.score_watchlist(spark.createDataFrame(rows + last_zero, schemas.BAR)), "company_id")
    assert got["Z"]["status"] == "bad_data"
    assert got["L"]["status"] == "ok" and got["L"]["latest_return"] == -1.0


@pytest.mark.parametrize("at", [0, 12, 29])
def test_a_close_that_is_no_number_is_bad_data(spark, at):
    rows = [bar("N", i * DAY, float("nan") if i == at else 10.0 + i % 3, 5) for i in range(30)]
    df = spark.createDataFrame(rows, schemas.BAR)
    row = anomaly.score_watchlist(df).first()
    assert (row["status"], row["flagged"], row["z_score"]) == ("bad_data", False, None)
    assert row["latest_close"] == (None if at == 29 else rows[-1][5])
    moved = anomaly.price_movement(df, spark.createDataFrame([("N", "n", None)], schemas.COMPANY)).first()
    assert moved["z_score"] is None and moved["direction"] is None


def test_scan_keeps_flagged_with_rounded_trigger(bars, companies):
    got = by_key(anomaly.scan_watchlist(bars, companies), "company_id")
    assert set(got) == {c for c, v in SCORED.items() if v[-1]}
    trigger = got["AAA"]["trigger"].asDict()
    assert trigger == {"z_score": -3.95, "volume_ratio": 3.07, "direction": "down", "latest_return_pct": -6.0}


def test_watchlist_restricts_the_scan(bars, companies):
    only = companies.filter(F.col("sector") == "S2")
    assert rows_of(anomaly.score_watchlist(bars, only), "company_id") == [("BB1",), ("BB2",), ("BB3",)]


def test_compute_trigger_scores_short_history(bars):
    got = by_key(anomaly.compute_trigger(bars), "company_id")
    assert "SHRT" in got and got["SHRT"]["n_bars"] == 29
    assert got["AAA"]["trigger"]["z_score"] == -3.95


def test_all_fired(bars):
    scores = anomaly.score_watchlist(bars)
    assert anomaly.assert_all_flagged(scores).first().asDict() == {"scored": 9, "fired": 6, "all_fired": False}
    assert anomaly.assert_all_flagged(scores.filter("flagged")).first()["all_fired"]


def test_z_does_not_depend_on_price_scale_or_row_order(bars):
    scaled = bars.withColumn("close", F.col("close") * 8).orderBy(F.rand(7))
    a = by_key(anomaly.score_watchlist(bars), "company_id")
    b = by_key(anomaly.score_watchlist(scaled), "company_id")
    for company in SCORED:
        assert a[company]["z_score"] == pytest.approx(b[company]["z_score"], abs=1e-9)


def test_scan_plan_has_one_shuffle_and_cuts_before_it(bars, spark, tmp_path):
    bars.write.parquet(str(tmp_path / "bars"))
    plan = plan_of(anomaly.score_watchlist(spark.read.parquet(str(tmp_path / "bars"))))
    assert plan.count("Exchange hashpartitioning(company_id") == 1
    assert plan.count("Exchange") == 1
    assert plan.count("WindowGroupLimit") == 2
    assert "ReadSchema: struct<company_id:string,ts_ms:bigint,close:double,volume:bigint>" in plan


def _random_bars(seed, companies=6):
    rng = random.Random(seed)
    rows = {}
    for c in range(companies):
        # one company with most of the bars, one with a single bar, one with two
        n = {0: 400, 1: 1, 2: 2}.get(c, rng.randint(5, 60))
        times = rng.sample(range(0, 45 * 24 * 60), n)
        rows[f"C{c}"] = sorted((t * 60_000, round(rng.uniform(1, 200), 2), rng.randint(0, 50)) for t in times)
    return rows


@pytest.mark.parametrize("bucket", [DAY, 3_600_000, 60 * DAY])
def test_price_movement_matches_plain_computation(spark, bucket):
    data = _random_bars(3)
    rows = [bar(c, *b) for c, bs in data.items() for b in bs]
    names = spark.createDataFrame([(c, c, None) for c in [*data, "NONE"]], schemas.COMPANY)
    got = by_key(anomaly.price_movement(spark.createDataFrame(rows, schemas.BAR), names, 30, 12, bucket), "company_id")
    assert got["NONE"]["n_bars"] == 0 and got["NONE"]["latest_close"] is None
    for company, all_bars in data.items():
        start = all_bars[-1][0] - 30 * DAY
        window = [b for b in all_bars if b[0] >= start]
        row = got[company]
        assert row["n_bars"] == len(window)
        assert row["latest_close"] == window[-1][1]
        if len(window) < 2:
            assert row["z_score"] is None and row["direction"] is None
            continue
        ret, z, vol = statistics([b[1] for b in window], [b[2] for b in window])
        assert row["latest_return_pct"] == pytest.approx(ret * 100, abs=1e-8)
        assert row["z_score"] == pytest.approx(z, abs=1e-8)
        assert row["volume_ratio"] == pytest.approx(vol, abs=1e-8)
        assert row["direction"] == ("up" if ret > 0 else "down")


def test_movement_window_start_is_inclusive(spark, companies):
    rows = [bar("AAA", 0, 10.0, 1), bar("AAA", 1, 11.0, 1), bar("AAA", 30 * DAY + 1, 12.0, 1)]
    window = anomaly.movement_window(spark.createDataFrame(rows, schemas.BAR), 30)
    assert rows_of(window, "ts_ms") == [(1,), (30 * DAY + 1,)]


def test_returns_cross_bucket_borders(spark):
    data = _random_bars(5)
    rows = [bar(c, *b) for c, bs in data.items() for b in bs]
    got = {(r["company_id"], r["ts_ms"]): r for r in with_returns(spark.createDataFrame(rows, schemas.BAR)).collect()}
    for company, bs in data.items():
        for before, now in zip([None, *bs], bs):
            row = got[company, now[0]]
            assert row["prev_close"] == (before[1] if before else None)
            if before:
                assert row["ret"] == pytest.approx(now[1] / before[1] - 1)


def test_series_chunks_hold_everything_in_order(spark):
    data = _random_bars(9)
    rows = [bar(c, *b) for c, bs in data.items() for b in bs]
    chunks = series(spark.createDataFrame(rows, schemas.BAR), chunk=50).orderBy("company_id", "chunk_no").collect()
    joined = {}
    for r in chunks:
        assert len(r["series"]) <= 50
        joined.setdefault(r["company_id"], []).extend((p["timestamp"], p["close"], p["volume"]) for p in r["series"])
    assert joined == data


def test_day_change(spark):
    rows = [bar("A", 1, 10.0, 1), bar("A", 2, 12.5, 1), bar("B", 1, 0.0, 1), bar("B", 2, 3.0, 1), bar("C", 1, 4.0, 1), bar("D", 1, 5.0, 1), bar("D", 2, 5.0, 1)]
    got = by_key(day_change(spark.createDataFrame(rows, schemas.BAR)), "company_id")
    assert (got["A"]["pct"], got["A"]["positive"]) == (25.0, True)
    assert got["B"]["pct"] is None and got["C"]["pct"] is None
    assert (got["D"]["pct"], got["D"]["positive"]) == (0.0, True)


def test_ranges_prices_and_series(spark, bars):
    newest = anchors(bars).agg(F.max("anchor_ms")).first()[0]
    week = price_range(bars, "1W", newest).filter(F.col("company_id") == "AAA")
    assert [r["ts_ms"] for r in week.collect()] == sorted(r["ts_ms"] for r in week.collect())
    assert week.count() == 6
    assert by_key(latest_price(bars), "company_id")["AAA"]["latest_close"] == 94.0
    assert chart_series(bars, "line").columns == ["company_id", "time", "value"]
    with pytest.raises(ValueError):
        chart_series(bars, "area")
    assert last_n(bars, 5).groupBy("company_id").count().filter("count <> 5").count() == 0


def test_trading_days(spark):
    days = trading_days(spark, "2026-05-17", 3).collect()  # a Sunday
    got = [dt.datetime.fromtimestamp(d["ts_ms"] / 1000, dt.timezone.utc) for d in days]
    assert [g.day for g in got] == [13, 14, 15] and {g.hour for g in got} == {20}


def test_resample_daily(spark):
    rows = [("A", DAY + 5, 1.0, 4.0, 0.5, 2.0, 10), ("A", DAY + 9, 2.0, 3.0, 0.1, 2.5, 20), ("A", 3 * DAY, 9.0, 9.0, 9.0, 9.0, 1)]
    got = rows_of(resample_daily(spark.createDataFrame(rows, schemas.BAR)), "ts_ms", "open", "high", "low", "close", "volume")
    assert got == sorted([(DAY, 1.0, 4.0, 0.1, 2.5, 30), (3 * DAY, 9.0, 9.0, 9.0, 9.0, 1)], key=repr)
