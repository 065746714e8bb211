"""Nearest neighbours and benchmark search against brute force."""

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from movewatch.llm import decontaminate, neighbours, queries
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, prose


def plain_nearest(ids, vectors, k):
    out = {}
    for q in np.unique(ids[ids % 20 == 0]):
        best = {}
        for a in np.flatnonzero(ids == q):
            for b in np.flatnonzero(ids != q):
                score = float((vectors[a] * vectors[b]).sum())
                best[int(ids[b])] = max(best.get(int(ids[b]), -np.inf), score)
        out[int(q)] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = found(queries.QUERIES["op4_nearest_neighbours"](spark, path))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        hits, total = hits + len(best & {v for v, _ in got[ids[q]]}), total + len(best)
    assert hits / total >= 0.9


def test_all_probes_are_exact_with_ties_and_uneven_norms(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 6)) * rng.uniform(0.1, 5, (150, 1))
    x[40:100] = x[40]  # a very common vector, queries among it
    x[120], x[121] = -x[40], 2 * x[40]
    ids = np.arange(150) * 4
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = found(neighbours.search(df, F.col("vec_id") % 20 == 0, 20, tables=1, probes=1 << 20))
    assert got == plain_nearest(ids, x, 20)


@pytest.mark.parametrize("kind", ["spread", "outlier", "long few"])
def test_recall_with_uneven_norms(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "spread":
        x *= rng.lognormal(0, 0.7, (4000, 1))
    else:
        x[1 : 2 if kind == "outlier" else 300] *= 50
    ids = np.arange(4000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(6)
    got, best = found(neighbours.search(df, F.col("vec_id") % 20 == 0)), plain_nearest(ids, x, 20)
    assert all(len(got[q]) == 20 for q in best)
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in best[q]}) for q in best) >= 0.95 * 20 * len(best)


def test_query_that_finds_too_few_is_compared_with_all(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((np.eye(64)[:1] + rng.normal(size=(500, 64)) * 1e-3, -np.eye(64)[:1]))
    ids = np.arange(500, 1001)
    x[ids % 20 == 0] *= -1
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(neighbours.search(df, F.col("vec_id") % 20 == 0, 40)) == plain_nearest(ids, x, 40)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []),
            (None, [1.0, 1.0]), (20, None), (40, [0.0, 0.0]), (1, [2.0, 1.0]), (9, [1.0, -3.0]), (0, [1.0, 2.0]), (60, [-1.0, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rank string, score int")
    got = found(neighbours.search(df, F.col("vec_id") % 20 == 0, 20))
    assert got == {0: [(1, 4.0), (60, 0.0), (9, -5.0)], 60: [(0, 0.0), (1, -1.5), (9, -2.5)]}
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_ids_with_other_vectors_and_every_length(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    ids = np.arange(300) // 2 * 5  # every id twice, with different vectors
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    short, single = rng.normal(size=(90, 3)), rng.normal(size=(70, 1))
    rows += [(int(i), v.tolist()) for part in (short, single) for i, v in zip(np.arange(len(part)) * 10, part)]
    got = found(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 20 == 0, 30))
    want = defaultdict(dict)
    for own, part in ((ids, x), (np.arange(90) * 10, short), (np.arange(70) * 10, single)):
        for q, best in plain_nearest(own, part, len(own)).items():
            for v, score in best:
                want[q][v] = max(score, want[q].get(v, -np.inf))
    for q, best in want.items():
        assert [v for v, _ in got[q]] == [v for v, _ in sorted(best.items(), key=lambda b: (-b[1], b[0]))[:30]]
        assert [s for _, s in got[q]] == pytest.approx(sorted(best.values(), reverse=True)[:30])


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(5, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for axes in neighbours.signed_axes(x, 3):
        assert np.allclose((axes[:, :8] ** 2).sum(axis=1), 1) and np.array_equal(axes[:, :8], -axes[:, 8:])


# --- benchmark ---

def plain_edits(item, text):
    """Least edits with which ``item`` occurs in ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=24), st.text("abc", max_size=60), st.integers(2, 4))
def test_leaks_equal_plain(item, text, q):
    items = decontaminate.Items([5], [item], q, 0.2)
    budget = decontaminate.edit_budget(len(item), 0.2, q)
    got = decontaminate.leaks(items, text)
    least = plain_edits(item, text)
    assert [(i, e) for i, _, _, e in got] == ([(0, least)] if least <= budget else [])
    assert not got or 1 in decontaminate._suspects(items, ["zz", text, "yy"])
    for _, start, end, edits in got:
        assert plain_edits(item, text[start:end]) == edits


def edited(text, rnd, edits):
    chars = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(chars))
        rnd.choice([lambda: chars.__setitem__(at, "#"), lambda: chars.__delitem__(at), lambda: chars.insert(at, "@")])()
    return "".join(chars)


def test_planted_items_are_found_and_clean_documents_left(spark):
    rnd = random.Random(8)
    items = [(i, prose(7000 + i, 20 + i)) for i in range(30)] + [(90, "Short 7"), (91, None), (92, ""), (93, prose(7003, 23))]
    rows, expected = [], set()
    for doc in range(300):
        text = prose(doc, 40)
        if doc % 3 == 0:
            i, item = items[rnd.randrange(30)]
            changed = edited(item, rnd, rnd.randrange(decontaminate.edit_budget(len(item), 0.1, 8) + 1))
            text = f"{text}\n {changed.upper()}  {prose(9000 + doc, 30)}"
            expected |= {(doc, i)} | ({(doc, 93)} if i == 3 else set())
        rows.append((doc, text, "en", "s", 1))
    rows += [(300, "a sHort \t7 b", "en", "s", 1), (301, None, None, None, None), (302, "", "en", "s", 0), (None, items[2][1] + " " + prose(1, 5000), "en", "s", 1)]
    expected |= {(300, 90), (None, 2)}
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_CHARS, 900):
        got = decontaminate.find(docs, benchmark, block_chars=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
        kept = decontaminate.clean(docs, benchmark, block_chars=block)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({r[0] for r in rows if r[0] is not None} - {d for d, _ in expected})


def phrased(n_items, times, seed=3):
    """Items that share a phrase of 56 characters, a text that holds it many times and some of the items, and which."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randrange(3, 9)))
    phrase = "which of the following statements about the topic is tru"
    items = [f"{phrase} {' '.join(word() for _ in range(8))}" for _ in range(n_items)]
    planted = set(range(0, n_items, max(1, n_items // 7)))
    parts = [f"{phrase} {' '.join(word() for _ in range(12))}" for _ in range(times)]
    for at, i in enumerate(planted):
        k = decontaminate.edit_budget(len(items[i]), 0.1, 8)
        parts.insert(at * times // 9, edited(items[i], rnd, at % (k + 1)))
    return items, " ".join(parts), planted


def test_a_phrase_that_all_items_share(monkeypatch):
    items, text, planted = phrased(300, 60)
    for hits, part_items in ((decontaminate.HITS, 512), (3000, 50)):
        monkeypatch.setattr(decontaminate, "HITS", hits)
        monkeypatch.setattr(decontaminate, "PART_ITEMS", part_items)
        held = decontaminate.Items(list(range(len(items))), items, 8, 0.1)
        assert {i for i, *_ in decontaminate.leaks(held, text)} == planted
    for i in sorted(planted)[:3]:
        assert plain_edits(items[i], text) <= held.budget[i]


def test_memory_stays_bounded_where_a_phrase_is_common():
    peaks = []
    for times in (60, 240):
        items, text, planted = phrased(600, times)
        held = decontaminate.Items(list(range(len(items))), items, 8, 0.1)
        tracemalloc.start()
        assert {i for i, *_ in decontaminate.leaks(held, text)} == planted
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    # 1.8 and 7 million shared q-grams; what is held follows HITS
    assert peaks[1] < 500e6 and peaks[1] < 2 * peaks[0]
    assert 1 in decontaminate._suspects(held, ["which of the following", text])


def test_empty_sides(spark, edge_docs, no_docs):
    benchmark = spark.createDataFrame([(1, prose(2, 60))], "item_id long, text string")
    assert decontaminate.find(no_docs, benchmark).count() == 0
    assert decontaminate.find(edge_docs, benchmark.limit(0)).count() == 0
    assert decontaminate.clean(edge_docs, benchmark.limit(0)).count() == edge_docs.count()
    assert {r.doc_id for r in decontaminate.find(edge_docs, benchmark).collect()} == {3, 11, 12}


def test_query_equals_substring_search(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    exact = {(d, i) for d, t in docs for i, x in items if x in t}
    got = queries.QUERIES["op3_decontaminate"](spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.edits == 0} == exact and len(exact) > 10
