"""Quality scores by regularised quadratic discriminant analysis over document statistics.

Each document becomes a short vector of statistics of its whole text, transformed so that they are
roughly normal. Per class the sums of x and x x' over all labelled training rows are made by one
aggregation (no sample, and only d + d*d + 1 numbers a class reach the driver); the class covariances
are shrunk towards their pooled diagonal, and their Cholesky factors are kept in the model. A score is
the logistic of the difference in log density, from the Mahalanobis distances, plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewatch.llm.common import free_name, in_slices
from movewatch.session import materialized

FEATURES = (
    "log_words", "word_length", "word_spread", "upper", "symbols", "bars", "marked_words",
    "digits", "stops", "line_words", "distinct", "repeats", "top_word",
)
FOLDS = 5
_KIND = np.zeros(256, np.uint8)  # 1 white space, 2 lower case or beyond ASCII, 3 upper case, 4 digit, 5 sentence mark, 6 other symbol
_KIND[[32, *range(9, 14)]] = 1
_KIND[range(97, 123)] = _KIND[128:] = 2
_KIND[range(65, 91)] = 3
_KIND[range(48, 58)] = 4
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 5
_KIND[_KIND == 0] = 6


def statistics(text: str | None) -> np.ndarray:
    """The feature vector of one text; null counts as empty, and empty texts have all zeros but defined shares."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    kind = _KIND[raw]
    count = np.bincount(kind, minlength=7).astype(float)
    solid = kind != 1
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = len(start)
    if not words:
        return np.zeros(len(FEATURES))
    length = end - start
    # a word's code, without case: its bytes weighted by their place in it, summed, wrapping
    at = np.flatnonzero(solid)
    first = np.cumsum(length) - length
    place = (at - np.repeat(start, length) + 1).astype(np.uint64)
    folded = np.where(kind == 3, raw | 32, raw)[at].astype(np.uint64)
    mixed = (folded + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15))
    mixed ^= mixed >> np.uint64(29)
    code = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), first)
    _, times = np.unique(code, return_counts=True)
    lines = 1 + np.count_nonzero(raw[: end[-1]] == 10)
    solid_bytes = len(raw) - count[1]
    letters = count[2] + count[3]
    per_word = np.add.reduceat((kind == 6).astype(np.int32), start)
    expected = min(words, 30.0 * np.sqrt(words))
    return np.array([
        np.log1p(words),
        np.log(length.mean()),
        length.std() / length.mean(),
        np.sqrt(count[3] / max(letters, 1)),
        np.sqrt(count[6] / solid_bytes),
        np.sqrt(np.count_nonzero(raw == 124) / words),
        np.sqrt(np.count_nonzero(per_word) / words),
        np.sqrt(count[4] / solid_bytes),
        np.sqrt(count[5] / words),
        np.log1p(words / lines),
        len(times) / expected,
        np.sqrt(np.count_nonzero(code[1:] == code[:-1]) / words),
        np.sqrt(times.max() / (words + 10)),
    ])


@dataclass(frozen=True)
class Model:
    """Per class (0, 1): mean, inverse of the Cholesky factor, log determinant; and the log prior odds of 1."""

    means: np.ndarray
    inverses: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [
            -0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) - 0.5 * d for m, inv, d in zip(self.means, self.inverses, self.log_dets)
        ]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -500, 500)))


def discriminant(count: np.ndarray, total: np.ndarray, square: np.ndarray, shrinkage: float, floor: float = 1e-3) -> Model:
    """The model from each class's number of rows, sum of x and sum of x x'.

    Without rows of one class all scores are the smoothed share of 1 among the labels (0.5 without any).
    """
    d = total.shape[1]
    odds = float(np.log((count[1] + 1) / (count[0] + 1)))
    if not count.all():
        return Model(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), odds)
    means = total / count[:, None]
    spread = square / count[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (spread * count[:, None, None]).sum(axis=0) / count.sum()
    target = np.diag(np.diag(pooled) + floor)
    inverses, log_dets = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * spread[c] + shrinkage * target + floor * np.eye(d))
        inverses.append(np.linalg.inv(factor))
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return Model(means, np.array(inverses), np.array(log_dets), odds)


def features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``features``, an array of doubles in the order of FEATURES, for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t).tolist() for t in batch.column(0).to_pylist()]
            made = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], [*batch.schema.names[1:], "features"])

    narrow = df.select(F.col(text).alias(free_name(df, "_text")), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])
    return narrow.mapInArrow(in_slices(run), f"{schema}, features array<double>")


def held_out(key: Column) -> Column:
    """Whether a row is kept from training; null keys are."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", shrinkage: float = 0.05) -> Model:
    """The model of the training rows of ``labels`` (``key``, ``label`` 0 or 1; others are left out).

    A key that is labelled twice counts twice.
    """
    marked = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).filter(
        F.col("_label").isin(0, 1) & ~held_out(F.col("_key"))
    )
    rows = stats.join(marked, F.col(key) == F.col("_key")).select("_label", "features")
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = np.asarray(batch.column(0).to_pylist())
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["c", "sums"])

    parts = rows.mapInArrow(moments, "c int, sums array<double>").select("c", F.posexplode("sums").alias("i", "v"))
    sums = np.zeros((2, 1 + d + d * d))
    for c, i, v in parts.groupBy("c", "i").agg(F.sum("v").alias("v")).collect():
        sums[c, i] = v
    return discriminant(sums[:, 0], sums[:, 1 : d + 1], sums[:, d + 1 :].reshape(2, d, d), shrinkage)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with ``score`` in place of ``features``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(batch.num_columns - 1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(model.scores(x))], [*batch.schema.names[:-1], "score"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields[:-1])
    return stats.mapInArrow(run, f"{schema}, score double")


def scored(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.05) -> DataFrame:
    """doc_id and score of every document, learned from the labels' training rows.

    Texts are read once: their statistics (a dozen numbers a document) are written to the shared folder.
    Null and empty texts are scored like any; an empty table gives an empty one.
    """
    stats = materialized(features(docs), "quality-features")
    return score(stats, fit(stats, labels, shrinkage=shrinkage))


def kept(docs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more."""
    model = fit(features(docs), labels)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(text).to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= least))

    return docs.mapInArrow(in_slices(run), docs.schema)
