"""Hard negatives against brute force over exact integers."""

import math
import random

import numpy as np
import pytest

from movewatch.llm import hard_negatives, queries
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string, node string"


def plain(rows):
    """All result rows for rows (id, vector, label), anchors those divisible by 100."""
    usable = {(i, l, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, l, v in usable:
        if i % 100:
            continue
        scored = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), j, m) for j, m, w in usable if j != i and len(w) == len(v)]
        scored.sort()
        for p, j, m in [s for s in scored if s[2] == l][:5]:
            fits = [(n, k) for n, k, m in scored if m != l and -80 * p <= -100 * n <= -100 * p][:5]
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **args):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **args)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(seed, n, dim=6, step=1.0, labels=3):
    rnd = random.Random(seed)
    return [(i, [round(rnd.gauss(0.5, 1) / step) * step for _ in range(dim)], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("step", [1.0, 0.001])
def test_against_brute_force_with_ties_in_many_blocks(spark, monkeypatch, step):
    # whole steps make many equal scores
    for name, value in (("FEW_ROWS", 64), ("ANCHORS", 2), ("CELLS", 50)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(1, 700, step=step)
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 50


def test_missing_values_odd_vectors_and_repeated_rows(spark):
    rows = vectors(2, 320, dim=4, labels=2)
    rows += [(None, [1.0] * 4, 1), (400, None, 1), (500, [1.0] * 4, None), (600, [1.0, None, 1.0, 1.0], 1), (700, [float("nan")] * 4, 1), (701, [float("inf")] * 4, 0)]
    rows += [(800, [], 1), (801, [], 1), (802, [], 0), (900, [1.0, 2.0], 1), (901, [1.0, 2.5], 1), (902, [1.0, 1.9], 0), (1000, [5.0], 9)]
    rows += [(100, [1.0, 1.0, 0.5, 1.0], 1), (3, [1.0, 1.0, 1.0, 1.0], 0), *rows[100:110], (-100, [1.0] * 4, 0)]
    assert mined(spark, rows) == plain(rows)


def test_scores_beyond_doubles_and_beyond_64_bits(spark):
    big = [(0, 1.0), (1, 3.0), (2, 2.75), (3, 2.7), (4, 2.5), (5, -1.0)]
    rows = [(i, [f * 2.0**30, 1.0], i % 2) for i, f in big] + [(100 + i, [f * 2.0**20, 2.0**21 + i], i % 2) for i, f in big]
    assert mined(spark, rows) == plain(rows)
    mined(spark, [(0, [1e30, 1.0], 0), (1, [1e30, 1.0], 0), (2, [1e30, 2.0], 1)])


def test_one_label_few_rows_and_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.5], 2)]
    assert mined(spark, rows) == plain(rows) == [(0, 1, 1, 2, 65536, 58880)]


def test_query_on_given_vectors(spark):
    path = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows]
    assert sorted(tuple(r) for r in queries.QUERIES["op13_hard_negatives"](spark, path).collect()) == plain(rows)
