"""State that follows what changes: findings and daily digests."""

import pytest
from pyspark.sql import functions as F

from conftest import DAY, bar, fixture_bars, rows_of
from movewatch import schemas
from movewatch.operators.anomaly import price_movement, score_watchlist
from movewatch.operators.attribution import attribute
from movewatch.sources import digests, sinks
from movewatch.streaming import incremental

FINDING = ["company_id", "primary_driver", "hypothesis", "confidence", "needs_human_review"]


def full(bars, news, discussion, companies):
    return rows_of(attribute(score_watchlist(bars).filter("flagged"), news, discussion, companies), *FINDING)


@pytest.fixture
def dims(news, discussion, companies):
    return {"companies": companies, "news": news, "discussion": discussion}


@pytest.mark.parametrize("key", [lambda r: r[0], lambda r: r[1] // DAY % 3])
def test_any_cut_ends_in_the_full_cycle(spark, tmp_path, bars, news, discussion, companies, dims, key):
    parts = {}
    for row in fixture_bars():
        parts.setdefault(key(row), []).append(row)
    parts = list(parts.values())[-5:] if len(parts) > 5 else list(parts.values())
    base, every = str(tmp_path / "state"), []
    for i, rows in enumerate(parts):
        every += rows
        copies = [bar(r[0], r[1], 1.0, 1) for r in every[:3]] if i else []  # copies of stored bars change nothing
        # the news of the last batch is stored with it
        known = dims if i == len(parts) - 1 else {**dims, "news": news.limit(0)}
        changed = news.select("company_id") if i == len(parts) - 1 else None
        incremental.cycle(spark.createDataFrame(rows + copies, schemas.BAR), known, base, i, changed, buckets=3)
    last = len(parts) - 1
    seen = spark.createDataFrame(every, schemas.BAR)
    want = full(seen, news, discussion, companies)
    assert rows_of(incremental.findings(spark, base, last), *FINDING) == want and want
    bad = rows_of(score_watchlist(seen).filter("status <> 'ok'"), "company_id")
    assert rows_of(incremental.unusable(spark, base, last), "company_id") == bad
    # a batch that is run again finds what it found, and leaves the same
    incremental.cycle(spark.createDataFrame(parts[-1], schemas.BAR), dims, base, last, news.select("company_id"), buckets=3)
    assert rows_of(incremental.findings(spark, base, last), *FINDING) == want
    assert incremental.drop_old(spark, base, last) > 0
    assert rows_of(incremental.findings(spark, base, last), *FINDING) == want


def test_what_is_read_and_written_follows_the_change(spark, tmp_path, bars, news, discussion, companies, dims):
    base = str(tmp_path / "state")
    incremental.cycle(bars, dims, base, 0, buckets=32)
    end = max(r[1] for r in fixture_bars())
    # one more bar of BB1, down with its sector, then flat: it leaves its group
    late = [bar("BB1", end + DAY, 95.5, 1000)]
    incremental.cycle(spark.createDataFrame(late, schemas.BAR), dims, base, 1, buckets=32)
    now = incremental.versions(spark, base, 1)
    assert {p: sum(1 for (q, _), v in now.items() if q == p and v == 1) for p in ("bars", "scores")} == {"bars": 1, "scores": 1}
    assert sum(v == 1 for (p, _), v in now.items() if p == "movers") <= 2
    assert sum(v == 1 for (p, _), v in now.items() if p == "findings") <= 3  # BB1 and those who moved with it
    both = bars.unionByName(spark.createDataFrame(late, schemas.BAR))
    assert rows_of(incremental.findings(spark, base, 1), *FINDING) == full(both, news, discussion, companies)
    # a news item alone: no bar, one company
    item = spark.createDataFrame([("late", "CCC", "CCC loses a client", None, None, None, end)], schemas.NEWS)
    more = {**dims, "news": news.unionByName(item)}
    incremental.cycle(bars.limit(0), more, base, 2, item.select("company_id"), buckets=32)
    assert rows_of(incremental.findings(spark, base, 2), *FINDING) == full(both, more["news"], discussion, companies)
    last = incremental.versions(spark, base, 2)
    assert sum(v == 2 for (p, _), v in last.items() if p == "bars") == 1
    # nothing changed: nothing is written
    incremental.cycle(bars.limit(0), more, base, 3, buckets=32)
    assert incremental.versions(spark, base, 3) == last


def test_movement_from_digests_after_late_bars(spark, tmp_path, companies):
    rows = [bar("AAA", d * DAY + h * 3_600_000, 100.0 + (d * 7 + h * 3) % 11, 100 + h) for d in range(45) for h in (1, 9, 17)]
    rows += [bar("BB1", 44 * DAY, 5.0, 1), bar("BB2", 3 * DAY, 5.0, 1), bar("BB2", 40 * DAY, 0.0, 1), bar("BB2", 41 * DAY, 4.0, 1)]
    rows += [bar("CCC", d * DAY, None if d == 20 else 2.0 + d, 3) for d in range(30)]
    late = [r for i, r in enumerate(rows) if i % 4 == 1]
    bars_path, path = str(tmp_path / "bars"), str(tmp_path / "digests")
    order = [F.asc("close")]
    for part in ([r for r in rows if r not in late], late, late[:5]):
        digests.append_bars(spark.createDataFrame(part, schemas.BAR), bars_path, path, order)
    columns = ["company_id", "n_bars", "latest_close", "latest_return_pct", "z_score", "volume_ratio", "direction"]
    for days in (30, 7):
        want = rows_of(price_movement(spark.createDataFrame(rows, schemas.BAR), companies, days), *columns)
        assert rows_of(digests.price_movement(spark, bars_path, path, companies, days), *columns) == want
    # only the days of a late bar are digested again
    before = digests.open_digests(spark, path).inputFiles()
    digests.append_bars(spark.createDataFrame([bar("AAA", 2 * DAY + 5, 1.0, 1)], schemas.BAR), bars_path, path, order)
    after = digests.open_digests(spark, path).inputFiles()
    assert {f.split("day=")[1].split("/")[0] for f in set(after) - set(before)} == {"1970-01-03"}
    assert sinks.open_table(spark, "bar", bars_path).count() == len(rows) + 1
