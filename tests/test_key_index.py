import json

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows_of
from movewatch.sources import feeds, key_index, sinks
from movewatch.streaming import ingest

NEWS = "id string, company_id string, headline string, summary string, source string, url string, published_at long"


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def news(spark, ids, day=0):
    return spark.createDataFrame([(i, "A", f"h{i}", None, None, None, day * 86_400_000) for i in ids], NEWS)


def test_known_keys_are_found_and_no_others(spark, tmp_path):
    path = str(tmp_path / "index")
    key_index.create(spark, path, buckets=8, words=64)
    assert key_index.known(keys(spark, ["a"]), path).count() == 0
    key_index.add(keys(spark, [f"k{i}" for i in range(300)]), path)
    key_index.add(keys(spark, ["k1", "k2", "later", None]), path)
    asked = [f"k{i}" for i in range(250, 350)] + ["later", "k1", "k1", None, "never"]
    assert rows_of(key_index.known(keys(spark, asked), path), "key") == sorted((k,) for k in {*(f"k{i}" for i in range(250, 300)), "later", "k1"})
    passed = key_index.maybe(keys(spark, [f"new{i}" for i in range(1000)]), path).count()
    assert passed < 100  # a filter of 4096 bits over some 40 keys lets few pass


def test_only_touched_buckets_are_opened(spark, tmp_path):
    path = str(tmp_path / "index")
    key_index.create(spark, path, buckets=32, words=64)
    key_index.add(keys(spark, [f"k{i}" for i in range(2000)]), path)
    asked = keys(spark, ["k7", "k8"])
    buckets = key_index._numbers(asked.withColumn("bucket", key_index._bucket(32)))
    for part, schema in (("bits", key_index._BITS), ("keys", key_index._KEYS)):
        opened = key_index._part(spark, path, part, schema, buckets)
        files = [f for (f,) in opened.select(F.input_file_name()).distinct().collect()]
        assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} == set(buckets) and len(buckets) <= 2
        assert "PartitionFilters: [bucket" in plan_of(opened)
    assert opened.count() < 300  # of the 2000 keys of the history
    # an unknown key is stopped by the filter: no bucket's keys are opened
    assert key_index._numbers(key_index.maybe(keys(spark, ["never seen"]), path)) == []


def test_compacted_index_finds_the_same(spark, tmp_path):
    path = str(tmp_path / "index")
    key_index.create(spark, path, buckets=4, words=16)
    for i in range(4):
        key_index.add(keys(spark, [f"k{j}" for j in range(i * 50, i * 50 + 60)]), path)
    before = rows_of(key_index.known(keys(spark, [f"k{i}" for i in range(100, 400)]), path), "key")
    key_index.compact(spark, path, words=256)
    assert rows_of(key_index.known(keys(spark, [f"k{i}" for i in range(100, 400)]), path), "key") == before
    rows = spark.read.parquet(f"{path}/keys")
    assert rows.count() == rows.distinct().count() == 210 and len(rows.inputFiles()) == 4


def test_repeated_ids_add_nothing_on_any_day(spark, tmp_path):
    path = str(tmp_path / "news")
    order = [F.asc("company_id")]
    sinks.append_table(news(spark, ["1", "2"]), "news", path, order)
    sinks.append_table(news(spark, ["2", "3", None], day=400), "news", path, order)
    sinks.append_table(news(spark, ["1", "3"], day=800), "news", path, order)
    sinks.append_table(news(spark, []), "news", path, order)
    got = rows_of(sinks.open_table(spark, "news", path), "id", "published_at")
    assert got == [("1", 0), ("2", 0), ("3", 400 * 86_400_000)]


@pytest.mark.parametrize("lost_after", ["waiting", "index", "table"])
def test_an_append_that_was_cut_off_is_finished(spark, tmp_path, monkeypatch, lost_after):
    path = str(tmp_path / "news")
    order = [F.asc("company_id")]
    sinks.append_table(news(spark, ["1"]), "news", path, order)

    class Lost(Exception):
        pass
    real = sinks._store

    def cut_off(rows, indexed, index, target):
        if lost_after == "index":
            key_index.add(indexed.select(F.col("id").alias("key")), index)
        if lost_after == "table":
            real(rows, indexed, index, target)
        raise Lost
    monkeypatch.setattr(sinks, "_store", cut_off)
    with pytest.raises(Lost):
        sinks.append_table(news(spark, ["1", "2", "3"]), "news", path, order)
    monkeypatch.undo()
    sinks.append_table(news(spark, ["2", "4"], day=9), "news", path, order)
    got = rows_of(sinks.open_table(spark, "news", path), "id", "published_at")
    assert got == [("1", 0), ("2", 0), ("3", 0), ("4", 9 * 86_400_000)]


def test_a_table_from_before_the_index_gets_one(spark, tmp_path):
    path = str(tmp_path / "news")
    sinks._with_day(news(spark, ["1", "2"]), "news").write.partitionBy("day").parquet(path)
    sinks.append_table(news(spark, ["2", "3"], day=5), "news", path, [F.asc("company_id")])
    assert rows_of(sinks.open_table(spark, "news", path), "id") == [("1",), ("2",), ("3",)]


def article(i):
    return {"id": f"id{i}", "content": {"title": f"t{i}", "pubDate": "2024-01-01T00:00:00Z", "canonicalUrl": {"url": "u"}}}


def test_landed_files_and_their_corrupt_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps({"ticker": "A", "payload": json.dumps([article(1), article(2)]), "other": 5}), '{"ticker": "B", "payl', ""]
    (folder / "one.json").write_text("\n".join(lines))
    # a payload may be JSON itself
    (folder / "two.json").write_text(json.dumps({"ticker": "C", "payload": [article(3)]}) + "\n[1, 2\n")
    rows = feeds.landed(spark, "news", str(folder))
    assert rows_of(feeds.ingest_news(feeds.readable(rows)), "id", "company_id", "reason") == [("id1", "A", None), ("id2", "A", None), ("id3", "C", None)]
    refused = [(r["file"].split("/")[-1], r["corrupt"]) for r in feeds.corrupt(rows).collect()]
    assert sorted(refused) == [("one.json", '{"ticker": "B", "payl'), ("two.json", "[1, 2")]

    stream = feeds.landed(spark, "news", str(folder), stream=True, files_per_batch=1)
    target = str(tmp_path / "news")
    ingest.stream_ingest(stream, "news", target, str(tmp_path / "ckpt")).awaitTermination()
    assert rows_of(sinks.open_table(spark, "news", target), "id") == [("id1",), ("id2",), ("id3",)]
    assert spark.read.parquet(f"{target}_corrupt").count() == 2


def test_landed_price_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = {"ticker": "A", "ts": "2024-01-01T00:00:00Z", **{c: "1.5" for c in ("open", "high", "low", "close")}, "volume": 7, "poll": "p1"}
    (folder / "a.json").write_text(json.dumps(row) + "\nnot json\n")
    rows = feeds.landed(spark, "bar", str(folder), extra="poll string")
    assert rows_of(feeds.ingest_bars(feeds.readable(rows), poll=["poll"]), "close", "volume", "reason") == [(1.5, 7, None)]
    assert feeds.corrupt(rows).count() == 1
