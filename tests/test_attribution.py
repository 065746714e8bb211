import datetime as dt

from pyspark.sql import functions as F

from conftest import EVENT_DAY, by_key, ms, rows_of
from movewatch import schemas
from movewatch.functions.scalar import has_advice
from movewatch.operators.anomaly import score_watchlist
from movewatch.operators.attribution import AttributionParams, attribute, evidence_items, prior_weekday, sector_members
from movewatch.sources.sinks import finding_rows


def test_known_causes(bars, news, discussion, companies):
    got = by_key(attribute(score_watchlist(bars).filter("flagged"), news, discussion, companies), "company_id")
    want = {
        "AAA": ("news", "high", False), "BB1": ("sector", "medium", False), "BB2": ("sector", "medium", False),
        "BB3": ("sector", "medium", False), "CCC": ("unexplained", "low", True), "VOL": ("discussion", "medium", False),
    }
    assert {c: (r["primary_driver"], r["confidence"], r["needs_human_review"]) for c, r in got.items()} == want
    # the answer from after the session is no cause, and the stale item is not cited
    assert [e["ref"] for e in got["AAA"]["evidence"]] == ["Aaa cuts guidance"]
    assert [(e["type"], e["ref"]) for e in got["BB1"]["evidence"]] == [("sector", "BB2"), ("sector", "BB3")]
    assert got["CCC"]["evidence"] == [] and len(got["VOL"]["evidence"]) == 3
    assert got["VOL"]["posts_causal"] == 6 and got["BB1"]["peers_alike"] == 2


def test_all_evidence_in_long_form(bars, news, discussion, companies):
    flagged = score_watchlist(bars).filter("flagged")
    items = rows_of(evidence_items(flagged, news, discussion, companies), "company_id", "type", "item_id")
    assert items == [("AAA", "news", "n1")] + [("VOL", "discussion", f"d{i}") for i in range(6)]
    members = rows_of(sector_members(flagged, companies), "company_id", "peers_alike")
    assert ("BB1", 2) in members and ("CCC", 0) in members


def test_least_number_of_news(bars, news, discussion, companies):
    found = attribute(score_watchlist(bars).filter("flagged"), news, discussion, companies, AttributionParams(min_news=2))
    assert by_key(found, "company_id")["AAA"]["primary_driver"] == "unexplained"


def test_texts_give_no_advice(bars, news, discussion, companies):
    found = attribute(score_watchlist(bars).filter("flagged"), news, discussion, companies)
    assert found.filter(has_advice("hypothesis")).count() == 0


def test_two_peers_are_needed(bars, news, discussion, companies):
    flagged = score_watchlist(bars).filter(F.col("company_id").isin("BB1", "BB2"))
    got = by_key(attribute(flagged, news, discussion, companies), "company_id")
    assert got["BB1"]["primary_driver"] == "unexplained"
    loose = attribute(flagged, news, discussion, companies, AttributionParams(min_peers=1))
    assert by_key(loose, "company_id")["BB1"]["primary_driver"] == "sector"


def test_peers_must_move_the_same_way(spark, bars, news, discussion, companies):
    flagged = score_watchlist(bars).filter("flagged").withColumn(
        "direction", F.when(F.col("company_id") == "BB3", "up").otherwise(F.col("direction"))
    )
    got = by_key(attribute(flagged, news, discussion, companies), "company_id")
    assert got["BB1"]["primary_driver"] == "unexplained" and got["BB3"]["peers_alike"] == 0


def test_session_borders(spark, bars, discussion, companies):
    """Thursday's first instant counts for a Friday move, Wednesday's last does not."""
    flagged = score_watchlist(bars).filter(F.col("company_id") == "CCC")
    thursday = ms(dt.datetime(2026, 5, 14, tzinfo=dt.timezone.utc))
    for when, driver in ((thursday, "news"), (thursday - 1, "unexplained"), (thursday + 2 * 86_400_000 - 1, "news"), (thursday + 2 * 86_400_000, "unexplained")):
        news = spark.createDataFrame([("x", "CCC", "h", None, None, None, when)], schemas.NEWS)
        assert attribute(flagged, news, discussion, companies).first()["primary_driver"] == driver


def test_steady_discussion_is_not_unusual(spark, bars, news, companies):
    flagged = score_watchlist(bars).filter(F.col("company_id") == "VOL")
    rows = [(f"p{d}-{i}", "VOL", "t", "", "b", None, ms(EVENT_DAY - dt.timedelta(days=d, hours=i))) for d in range(7) for i in range(3)]
    posts = spark.createDataFrame(rows, schemas.DISCUSSION)
    assert attribute(flagged, news, posts, companies).first()["primary_driver"] == "unexplained"


def test_prior_weekday(spark):
    days = spark.createDataFrame([("2026-05-15",), ("2026-05-16",), ("2026-05-17",), ("2026-05-18",)], "d string")
    got = [str(r[0]) for r in days.select(prior_weekday(F.col("d").cast("date"))).collect()]
    assert got == ["2026-05-14", "2026-05-15", "2026-05-15", "2026-05-15"]


def test_finding_rows_are_repeatable(bars, news, discussion, companies):
    found = attribute(score_watchlist(bars).filter("flagged"), news, discussion, companies)
    a, b = by_key(finding_rows(found, 1), "id"), by_key(finding_rows(found, 1), "id")
    assert set(a) == set(b) and len(a) == 6
    assert set(by_key(finding_rows(found, 2), "id")).isdisjoint(a)
    assert all(len(i) == 36 and i.count("-") == 4 for i in a)
