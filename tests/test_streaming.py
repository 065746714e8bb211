import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DAY, bar, by_key, fixture_bars, rows_of
from movewatch import schemas
from movewatch.operators.anomaly import score_watchlist
from movewatch.operators.attribution import attribute
from movewatch.sources import sinks
from movewatch.streaming import ingest, scan, worker


def batches(spark, tmp_path, parts, schema):
    """Each part becomes one file, and one batch of the stream."""
    folder = str(tmp_path / "in")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def news_poll(*ids):
    return json.dumps([{"id": i, "content": {"title": i, "pubDate": "2024-01-01T00:00:00Z", "canonicalUrl": {"url": "u"}}} for i in ids])


def test_ingest_keeps_one_copy_over_batches(spark, tmp_path):
    raw = batches(spark, tmp_path, [[("A", news_poll("1", "2"))], [("B", news_poll("2", "3"))], [("A", news_poll("1", "4")), ("C", news_poll("4"))]], "ticker string, payload string")
    target = str(tmp_path / "news")
    ingest.stream_ingest(raw, "news", target, str(tmp_path / "ckpt")).awaitTermination()
    got = sinks.open_table(spark, "news", target)
    assert rows_of(got, "id") == [("1",), ("2",), ("3",), ("4",)]
    # the same input under a new checkpoint is the batch of a crashed run coming back
    ingest.stream_ingest(raw, "news", target, str(tmp_path / "ckpt2")).awaitTermination()
    assert sinks.open_table(spark, "news", target).count() == 4


def test_ingest_writes_refused_rows_aside(spark, tmp_path):
    rows = [("A", "2024-01-01T00:00:00Z", "1", "1", "1", "1", "1"), ("A", "soon", "1", "1", "1", "1", "1")]
    raw = batches(spark, tmp_path, [rows], "ticker string, ts string, open string, high string, low string, close string, volume string")
    target = str(tmp_path / "bars")
    ingest.stream_ingest(raw, "bar", target, str(tmp_path / "ckpt"), on_bad="row").awaitTermination()
    assert sinks.open_table(spark, "bar", target).count() == 1
    assert rows_of(spark.read.parquet(f"{target}_rejected"), "reason") == [("bad_ts",)]


def test_dedup_forgets_behind_the_watermark(spark, tmp_path):
    rows = [[("a", 0), ("a", 10), ("b", 20)], [("c", 10_000)], [("c", 10_001)], [("a", 10_002), ("c", 10_003)]]
    stream = batches(spark, tmp_path, rows, "id string, s long").withColumn("at", F.timestamp_seconds("s"))
    out = str(tmp_path / "out")
    first = ingest.stream_dedup(stream, ["id"], "at", "1 minute")
    first.writeStream.option("path", out).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    ids = [r["id"] for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == ["a", "a", "b", "c"]  # the late second "a" is past the delay


def scores_of(spark, stream, tmp_path, **params):
    target = str(tmp_path / "scores")
    scan.stream_scores(stream, target, str(tmp_path / "ckpt"), **params).awaitTermination()
    emitted = spark.read.schema(f"{scan.SCORE}, batch_id bigint").parquet(target)
    return emitted


def test_stream_scan_equals_batch_scan(spark, tmp_path, bars):
    rows = sorted(fixture_bars(), key=lambda r: (r[1] // DAY * 17) % 101)  # out of time order
    parts = [rows[i::4] for i in range(4)]
    # copies of stored time stamps are ignored, whatever they say
    parts[3] += [bar(r[0], r[1], 1.0, 1) for r in parts[0][:20]]
    emitted = scores_of(spark, batches(spark, tmp_path, parts, schemas.BAR), tmp_path)
    got = by_key(scan.latest_scores(emitted), "company_id")
    want = by_key(score_watchlist(bars), "company_id")
    assert set(got) == set(want)
    for company, row in want.items():
        for column, value in row.asDict().items():
            assert got[company][column] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (company, column)


def test_stream_scan_reports_each_batch(spark, tmp_path):
    days = [bar("A", d * DAY, 100.0 + d % 2, 1000) for d in range(30)]
    parts = [days[:29], [days[29]], [bar("A", 30 * DAY, 60.0, 9000)], [bar("A", -DAY, 1.0, 1)]]
    emitted = scores_of(spark, batches(spark, tmp_path, parts, schemas.BAR), tmp_path)
    got = sorted((r["batch_id"], r["anchor_ms"] // DAY, r["flagged"]) for r in emitted.collect())
    assert got == [(1, 29, False), (2, 30, True), (3, 30, True)]  # too old a bar changes nothing


@pytest.mark.parametrize("held_rows", [worker.HELD_ROWS, 1000])
def test_newest_bars_cut_is_per_partition(held_rows):
    frames = [pd.DataFrame({"company_id": ["hot"] * 90 + [f"c{i % 50}"] * 10, "ts_ms": range(i * 100, i * 100 + 100), "close": 1.0, "volume": 1}) for i in range(200)]
    out = pd.concat(worker.newest_bars(30, held_rows)(iter(frames)))
    hot = out[out.company_id == "hot"]
    assert hot.ts_ms.max() == 19_989 and set(range(19_960, 19_990)) <= set(hot.ts_ms)
    assert len(out) == 51 * 30 if held_rows == worker.HELD_ROWS else len(out) < 6000
    first = pd.concat(worker.newest_bars(2)(iter([pd.DataFrame({"company_id": ["A"], "ts_ms": [1], "close": [c], "volume": [1]}) for c in (1.0, 2.0)])))
    assert first.close.tolist() == [1.0]  # of two copies the first stays


def cut_by(rows, key):
    parts = {}
    for row in rows:
        parts.setdefault(key(row), []).append(row)
    return [parts[k] for k in sorted(parts)]


FINDING = ["company_id", "primary_driver", "hypothesis", "confidence", "needs_human_review"]


@pytest.mark.parametrize("cut", ["all at once", "a company a batch", "ten days a batch"])
def test_findings_stream_equals_batch_however_it_is_cut(spark, tmp_path, bars, news, discussion, companies, cut):
    rows = sorted(fixture_bars(), key=lambda r: r[1])
    keys = {"all at once": lambda r: 0, "a company a batch": lambda r: r[0], "ten days a batch": lambda r: r[1] // (10 * DAY)}
    parts = cut_by(rows, keys[cut])
    parts[-1] = parts[-1] + [bar(r[0], r[1], 1.0, 1) for r in parts[0][:3]] if len(parts) > 1 else parts[-1]  # copies of stored bars
    stream = batches(spark, tmp_path, parts, schemas.BAR)
    opened = []

    def dims(session):
        opened.append(1)
        # news that is stored while the stream runs
        known = news if len(opened) == len(parts) else news.limit(0)
        return {"companies": companies, "news": known, "discussion": discussion}

    paths = [str(tmp_path / p) for p in ("bars", "findings")]
    scan.stream_findings(stream, dims, *paths, str(tmp_path / "ckpt")).awaitTermination()
    want = attribute(score_watchlist(bars).filter("flagged"), news, discussion, companies)
    got = sinks.latest_cycle(spark, paths[1])
    assert rows_of(got, *FINDING) == rows_of(want, *FINDING)

    def nested(df):
        return sorted((r["company_id"], tuple(r["trigger"]), [tuple(e) for e in r["evidence"]]) for r in df.collect())

    assert nested(got) == nested(want)
    last = spark.read.parquet(f"{paths[1]}_rejected").filter(F.col("cycle") == len(parts) - 1)
    assert rows_of(last, "company_id", "status") == [("NULC", "bad_data")]
    assert sinks.open_table(spark, "bar", paths[0]).count() == len(rows)


def test_a_repeated_cycle_replaces_itself(spark, tmp_path, bars, news, discussion, companies):
    path = str(tmp_path / "findings")
    dims = {"companies": companies, "news": news, "discussion": discussion}
    for _ in range(2):
        scan.scan_cycle(bars, dims, path, 0)
    scan.scan_cycle(bars.filter("company_id <> 'AAA'"), dims, path, 1)
    per_cycle = {r["cycle"]: r["count"] for r in sinks.read_cycles(spark, path).groupBy("cycle").count().collect()}
    assert per_cycle == {0: 6, 1: 5} and sinks.latest_cycle(spark, path).count() == 5


def test_what_ingest_stores_does_not_depend_on_batches(spark, tmp_path):
    day = "2024-01-0"
    feed = [("A", f"{day}{1 + i // 4}T10:0{i % 3}:00Z", str(10.0 + i), "5" if i != 5 else "n/a", f"p{i // 4}", i) for i in range(12)]
    rows = [(t, ts, c, c, c, c, v, p, i) for t, ts, c, v, p, i in feed]
    schema = "ticker string, ts string, open string, high string, low string, close string, volume string, poll string, seq long"
    stored = []
    for name, parts in (("one", [rows]), ("polls", [rows[:4], rows[4:8], rows[8:]])):
        base = tmp_path / name
        base.mkdir()
        stream = batches(spark, base, parts, schema)
        target = str(base / "bars")
        ingest.stream_ingest(stream, "bar", target, str(base / "ckpt"), poll=["poll"], arrival=["seq"]).awaitTermination()
        refused = spark.read.parquet(f"{target}_rejected")
        stored.append((rows_of(sinks.open_table(spark, "bar", target), "ts_ms", "close"), rows_of(refused, "ts_ms", "reason")))
    assert stored[0] == stored[1] and stored[0][1]
    assert stored[0][0][0][1] == 10.0  # of two rows with one time the first stays
    with pytest.raises(ValueError):
        ingest.stream_ingest(batches(spark, tmp_path, [rows], schema), "bar", str(tmp_path / "x"), str(tmp_path / "y"))


def test_rows_without_a_required_value_are_kept_aside(spark):
    rows = [("n1", "A", None, None, None, None, 5), (None, "A", "h", None, None, None, 5), ("n2", "A", "h", None, None, None, 5)]
    df = spark.createDataFrame(rows, "id string, company_id string, headline string, summary string, source string, url string, published_at long")
    assert rows_of(sinks.unusable(df, "news"), "reason") == [("null:headline",), ("null:id",)]


def test_stored_scope_is_replaced_and_rerun_safe(spark, tmp_path):
    path = str(tmp_path / "bars")
    old = [bar(c, d * DAY, 1.0, 1) for c in ("A", "B") for d in range(3)] + [bar("A", 9 * DAY, 1.0, 1)]
    sinks.append_table(spark.createDataFrame(old, schemas.BAR), "bar", path, [F.asc("close")])
    new = spark.createDataFrame([bar("A", 1 * DAY, 2.0, 1), bar("A", 20 * DAY, 2.0, 1)], schemas.BAR)
    scope = spark.createDataFrame([("A",)], "company_id string")
    for _ in range(2):
        sinks.replace_stored(new, "bar", path, scope)
        got = rows_of(sinks.open_table(spark, "bar", path), "company_id", "ts_ms", "close")
        assert sorted(got) == [("A", DAY, 2.0), ("A", 20 * DAY, 2.0)] + [("B", d * DAY, 1.0) for d in range(3)]
