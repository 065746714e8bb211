"""Near-duplicate embeddings against all pairs."""

import numpy as np
import pytest

from movewatch.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, n_links string, cls string, node string"


def plain(rows, least=0.9):
    """Sorted (vec_id, n_links, component_id) by comparing all pairs, and the number of links."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for dim in {len(v) for (_, v), o in zip(rows, ok) if o}:
        at = [i for i, (_, v) in enumerate(rows) if ok[i] and len(v) == dim]
        x = np.array([rows[i][1] for i in at])
        for p, i in enumerate(at):
            near = np.flatnonzero(embedding_dedup.cosines(x, np.repeat(x[p : p + 1], len(x), 0)) >= least)
            links[i] = len(near) - 1
            for q in near:
                a, b = find(i), find(at[q])
                root[max(a, b)] = min(a, b)
    least_id = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least_id[find(i)] = min(own, least_id.get(find(i), own))
    return sorted(((own, links[i], least_id.get(find(i))) for i, (own, _) in enumerate(rows)), key=str)


def grouped(spark, rows, **args):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(4)
    got = embedding_dedup.near_duplicates(df, **args).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def around(rng, middle, n, noise):
    """Vectors at some angle to a direction; lengths differ."""
    return (middle + rng.normal(size=(n, len(middle))) * noise / np.sqrt(len(middle))) * rng.uniform(0.1, 9, (n, 1))


def clusters(seed, dim=16):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(150, dim))]
    for n, noise in ((60, 0.05), (60, 0.2), (40, 0.35), (60, 0.6), (5, 0.1), (2, 0.3), (2, 0.45)):
        middle = rng.normal(size=dim)
        parts.append(around(rng, middle / np.linalg.norm(middle), n, noise))
    x = np.concatenate(parts)
    x = np.concatenate((x, x[160:175], -x[160:165]))  # copies and opposites
    ids = rng.permutation(len(x)) * 3
    return [(int(i), v.tolist()) for i, v in zip(ids, x)]


@pytest.mark.parametrize("block", [4096, 8])
def test_against_all_pairs(spark, monkeypatch, block):
    # few hashes a table: everything meets, so the result is that of all pairs
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 2)
    rows = clusters(5)
    got = grouped(spark, rows, tables=8, hashes=1)
    assert got == plain(rows) and sum(n > 0 for _, n, _ in got) > 100


def test_production_parameters_find_links(spark):
    rows = clusters(6, dim=64)
    want = plain(rows)
    got = grouped(spark, rows)
    total = sum(n for _, n, _ in want)
    assert all(a <= b for (_, a, _), (_, b, _) in zip(got, want)) and sum(n for _, n, _ in got) >= 0.97 * total


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.901 * x + np.sqrt(1 - 0.901**2) * side
    far = 0.899 * x - np.sqrt(1 - 0.899**2) * side
    rows = [(i + 10_000 * k, v.tolist()) for k, m in enumerate((x, near, far)) for i, v in enumerate(m)]
    got = grouped(spark, rows)
    found = sum(n for i, n, _ in got if i < 10_000)
    assert found >= 0.96 * 1500 and all(n == 0 for i, n, _ in got if i >= 20_000)
    assert all(c == i % 10_000 for i, n, c in got if n)


def test_unusable_vectors_repeated_rows_and_null_ids(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(1, v), (1, v), (2, [2.0, 4.0, 6.0]), (None, v), (None, w), (None, None), (3, None), (4, []), (5, [0.0] * 3), (6, [1.0, None, 2.0])]
    rows += [(7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (9, [1e200, 2e200]), (10, [1e-200, 2e-200]), (11, [-1.0, -2.0, -3.0])]
    got = grouped(spark, rows, hashes=1)
    assert got == plain(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_duplicates(df).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([(1, None, "", "", "")], SCHEMA)).collect() == [(1, 0, 1, True)]
