import json

import pytest
from pyspark.sql import functions as F

from conftest import DAY, bar, by_key, plan_of, rows_of
from movewatch import schemas
from movewatch.operators.quality import check_constraints
from movewatch.sources import feeds, sinks, tables


def article(i, url="u", date="2024-01-01T00:00:00Z", **more):
    content = {"title": f"t{i}", "summary": None, "pubDate": date, "canonicalUrl": {"url": url} if url is not None else None, "provider": {"displayName": "p"}}
    return {"id": f"id{i}", "content": content, **more}


def polls(spark, payloads):
    return spark.createDataFrame([(t, json.dumps(p)) for t, p in payloads], "ticker string, payload string")


def test_news_cut_comes_before_the_url_rule(spark):
    raw = polls(spark, [("A", [article(1), article(2, url=""), article(3), article(4), article(5), article(6)])])
    rows = feeds.ingest_news(raw)
    assert rows_of(feeds.accepted(rows), "id", "pos") == [("id1", 0), ("id3", 2), ("id4", 3), ("id5", 4)]
    assert rows_of(feeds.rejected(rows), "id", "reason") == [("id2", "no_url")]
    first = by_key(rows, "id")["id1"]
    assert (first["headline"], first["summary"], first["source"], first["published_at"]) == ("t1", "", "p", 1704067200000)


def test_news_stops_at_a_bad_article(spark):
    raw = polls(spark, [("A", [article(1), article(2, url=None), article(3, date="soon"), article(4)]), ("B", [article(5)]), ("C", [])])
    assert rows_of(feeds.ingest_news(raw), "id", "reason") == [("id1", None), ("id2", "no_url"), ("id3", "bad_date"), ("id4", "after_bad"), ("id5", None)]
    row = feeds.ingest_news(raw, on_bad="row")
    assert rows_of(feeds.accepted(row), "id") == [("id1",), ("id4",), ("id5",)]
    with pytest.raises(ValueError):
        feeds.ingest_news(raw, on_bad="guess")


def test_unreadable_polls_are_refused(spark):
    raw = spark.createDataFrame([("A", "oops"), ("B", None), ("C", "{\"oops\": 1}"), ("D", "[{")], "ticker string, payload string")
    for ingest in (feeds.ingest_news, feeds.ingest_discussion):
        got = rows_of(feeds.rejected(ingest(raw)), "company_id", "reason")
        assert got == [(t, "bad_payload") for t in "ABCD"] and feeds.accepted(ingest(raw)).count() == 0
    empty = spark.createDataFrame([("A", "[]")], "ticker string, payload string")
    assert feeds.ingest_news(empty).count() == 0


def test_discussion(spark):
    messages = [{"id": 10 + i, "body": f"b{i}", "created_at": "2024-01-01T00:00:00Z"} for i in range(7)]
    messages[3]["created_at"] = "bad"
    got = by_key(feeds.ingest_discussion(polls(spark, [("A", {"messages": messages})])), "id")
    assert set(got) == {"10", "11", "12", "13", "14"}
    assert (got["10"]["title"], got["10"]["summary"], got["10"]["url"]) == ("b0", "", feeds.MESSAGE_URL + "10")
    assert got["13"]["reason"] == "bad_date" and got["14"]["reason"] == "after_bad"


def test_bars(spark):
    raw = spark.createDataFrame(
        [("A", f"2024-01-01T00:0{i}:00Z", "1", "2", "0.5", "NaN" if i == 0 else "1.5", v) for i, v in enumerate(["7.9", "n/a", "3"])]
        + [("B", "nope", "1", "1", "1", "1", "1"), ("B", "2024-01-01T00:09:00Z", "x", "1", "1", "1", "1"), ("C", "2024-01-01T00:00:00Z", "1", "1", "1", "1", "5")],
        feeds.BAR_FEED,
    )
    got = rows_of(feeds.ingest_bars(raw), "company_id", "close", "volume", "reason")
    assert set(got) == {("A", None, 7, None), ("A", 1.5, None, "bad_volume"), ("A", 1.5, 3, "after_bad"), ("B", 1.0, 1, "bad_ts"), ("B", 1.0, 1, "bad_price"), ("C", 1.0, 5, None)}
    assert feeds.accepted(feeds.ingest_bars(raw, on_bad="row")).count() == 3


def test_append_new_first_wins_and_repeats_add_nothing(spark):
    new = spark.createDataFrame([("1", "A", "first", 0), ("1", "B", "second", 1), ("2", "A", "old", 0), (None, "A", "no id", 0), ("3", "A", None, 0), ("4", "A", "ok", 0)],
                                "id string, company_id string, headline string, pos int")
    stored = spark.createDataFrame([("2", "A", "kept", 0)], new.schema)
    out = sinks.append_new(new, stored, ["id"], [F.asc("company_id"), F.asc("pos")], sinks.REQUIRED["news"])
    assert rows_of(out, "id", "headline") == [("1", "first"), ("4", "ok")]
    assert sinks.append_new(new, stored.unionByName(out), ["id"], [F.asc("pos")], ["headline"]).count() == 0
    assert plan_of(out).count("WindowGroupLimit") >= 1


def test_seed_and_replace(spark, companies):
    seed = spark.createDataFrame([*schemas.SEED_COMPANIES, ("AAA", "Other", "X")], schemas.COMPANY)
    assert rows_of(sinks.seed_missing(seed, companies), "company_id") == [("AAPL",), ("AMZN",), ("GOOGL",), ("MSFT",), ("NVDA",)]
    old = spark.createDataFrame([bar("A", 1, 1.0, 1), bar("B", 1, 2.0, 1), bar("C", 1, 2.0, 1)], schemas.BAR)
    new = spark.createDataFrame([bar("A", 5, 9.0, 9)], schemas.BAR)
    scope = spark.createDataFrame([("A",), ("C",)], "company_id string")
    once = sinks.replace_scope(new, old, scope)
    assert rows_of(once, "company_id", "ts_ms") == [("A", 5), ("B", 1)]
    assert rows_of(sinks.replace_scope(new, once, scope), "company_id", "ts_ms") == [("A", 5), ("B", 1)]


def test_stored_bars_are_pruned_by_day(spark, tmp_path):
    path = str(tmp_path / "bars")
    first = spark.createDataFrame([bar("A", d * DAY, 1.0, 1) for d in range(5)], schemas.BAR)
    sinks.append_table(first, "bar", path, [F.asc("close")])
    again = spark.createDataFrame([bar("A", d * DAY, 2.0, 1) for d in (3, 4, 5)], schemas.BAR)
    sinks.append_table(again, "bar", path, [F.asc("close")])
    sinks.append_table(again.limit(0), "bar", path, [F.asc("close")])
    got = sinks.open_table(spark, "bar", path)
    assert rows_of(got, "ts_ms", "close") == sorted([(d * DAY, 1.0) for d in range(5)] + [(5 * DAY, 2.0)], key=repr)
    day = got.filter(F.col("day") == "1970-01-03")
    assert day.count() == 1 and "PartitionFilters: [isnotnull(day" in plan_of(day)


def test_findings_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "findings")
    rows = spark.createDataFrame([("i1", "A", 5, (1.0, 2.0, "up", 3.0), "news", "h", [("news", "r", "w")], "high", False, 1, 0.1)], schemas.FINDING)
    for _ in range(2):
        sinks.write_findings(rows, path)
    assert sinks.read_findings(spark, path).select(*rows.columns).collect() == rows.collect()


def test_tables_read_with_their_schema(spark, bars, tmp_path):
    bars.write.parquet(str(tmp_path / "b"))
    got = tables.bars(spark, str(tmp_path / "b"))
    assert got.columns == bars.columns and got.count() == bars.count()
    assert "PushedFilters: [IsNotNull(ts_ms), GreaterThanOrEqual(ts_ms,5)]" in plan_of(got.filter("ts_ms >= 5"))


def test_constraints(spark, companies, news, discussion):
    bad_bars = spark.createDataFrame([("AAA", 1, 1.0), ("AAA", 1, 2.0), ("GONE", 2, 1.0), ("GONE", 3, 1.0), (None, 4, 1.0)], "company_id string, ts_ms long, close double")
    bad_news = news.unionByName(spark.createDataFrame([("n1", "AAA", "x", None, None, None, None)], schemas.NEWS)).withColumn(
        "headline", F.when(F.col("id") != "n2", F.col("headline")))
    got = rows_of(check_constraints({"company": companies, "bar": bad_bars, "news": bad_news, "discussion": discussion}), "table", "rule", "column", "key", "n")
    assert set(got) == {
        ("bar", "not_null", "company_id", None, 1), ("bar", "unique", "company_id,ts_ms", "AAA|1", 2), ("bar", "foreign_key", "company_id", "GONE", 2),
        ("news", "not_null", "headline", None, 1), ("news", "unique", "id", "n1", 2),
    }
