import random

from pyspark.sql import functions as F

from movewatch.operators.ordered import positions, prefix_sums, range_bucket, split_points, time_bucket, top_n


def _rows(seed, n=3000):
    rng = random.Random(seed)
    # one key holds a third of the rows, one value of the order many of them
    return [
        ("hot" if rng.random() < 0.34 else f"k{rng.randint(0, 20)}", 500 if rng.random() < 0.3 else rng.randint(0, 5000), i, rng.randint(0, 9))
        for i in range(n)
    ]


def test_prefix_sums_match_a_plain_loop(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "key string, seq long, id long, v long").repartition(7)
    points = split_points(df, "seq", 16)
    assert 1 < len(points) <= 15 and points == sorted(points)
    for keys in ([], ["key"]):
        out = prefix_sums(df, keys, ["seq", "id"], range_bucket("seq", points), {"before": F.col("v"), "n": F.lit(1)})
        got = {r["id"]: (r["before"], r["n"]) for r in out.collect()}
        sums, counts, want = {}, {}, {}
        for key, seq, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
            k = key if keys else None
            want[i] = (sums.get(k, 0), counts.get(k, 0))
            sums[k], counts[k] = sums.get(k, 0) + v, counts.get(k, 0) + 1
        assert got == want


def test_positions(spark):
    rows = _rows(2)
    df = spark.createDataFrame(rows, "key string, seq long, id long, v long")
    got = positions(df, ["key"], ["seq", "id"], time_bucket("seq", 100))
    seen = {}
    for r in got.orderBy("key", "seq", "id").collect():
        assert r["position"] == seen.get(r["key"], 0)
        seen[r["key"]] = r["position"] + 1


def test_top_n_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = top_n(df, ["k"], [F.desc("v")], 2, "rank")
    assert sorted((r["k"], r["v"], r["rank"]) for r in out.collect()) == [(0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)]
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
