"""The quality classifier: held-out accuracy, the discriminant against a plain formula, and edge cases."""

import zlib

import numpy as np
import pytest

from movewatch.llm import quality, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES["op6_quality"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def test_labels_of_the_held_out_fold_are_never_seen(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    spoiled = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    stats = quality.features(docs)
    a, b = quality.fit(stats, labels), quality.fit(stats, spoiled)
    assert np.array_equal(a.means, b.means) and a.log_odds == b.log_odds


def test_discriminant_equals_plain_densities():
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (200, 3)) @ rng.normal(0, 1, (3, 3))))
    y = np.repeat([0, 1], [300, 200])
    own = [x[y == c] for c in (0, 1)]
    model = quality.discriminant(
        np.array([len(o) for o in own], float), np.array([o.sum(0) for o in own]), np.array([o.T @ o for o in own]), 0.1
    )
    pooled = sum(np.cov(o.T, bias=True) * len(o) for o in own) / len(x)
    density = []
    for o in own:
        cov = 0.9 * np.cov(o.T, bias=True) + 0.1 * np.diag(np.diag(pooled) + 1e-3) + 1e-3 * np.eye(3)
        d = x - o.mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    expected = 1 / (1 + np.exp(-(density[1] - density[0] + np.log(201 / 301))))
    assert np.allclose(model.scores(x), expected)


def test_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (5, 7), (2, 1), (2, 1)], "doc_id long, quality int")
    rows = quality.scored(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert quality.scored(no_docs, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(edge_docs, none).collect()} == {0.5}
    one = labels.filter("quality = 1")
    assert len({r.score for r in quality.scored(edge_docs, one).collect()}) == 1
    kept = quality.kept(edge_docs, none, 0.3)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    assert quality.kept(edge_docs, none, 0.6).count() == 0


@pytest.mark.parametrize("text", [None, "", " \n", "x", " a", "a ", "é", "A" * 100_000, "a b " * 50_000, "퟿\U0001f600", "1\n2\n"])
def test_statistics_are_finite(text):
    assert np.isfinite(quality.statistics(text)).all() and len(quality.statistics(text)) == len(quality.FEATURES)


def test_repeated_words_are_seen_whatever_their_case_and_place():
    at = quality.FEATURES.index("repeats")
    assert quality.statistics("Und und UND und")[at] > 0.8 and quality.statistics("  one two\nthree")[at] == 0
    distinct = quality.FEATURES.index("top_word")
    assert quality.statistics("ab ba ab ba ab")[distinct] == pytest.approx(np.sqrt(3 / 15))
