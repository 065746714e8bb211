"""Suffix-array deduplication: bytes that lie in a string of a given length that occurs elsewhere are removed.

All texts are one collection of suffixes, of which only the first ``length`` bytes matter. Suffixes that can have
an equal are found by their anchors (repeats.py), sorted within their groups by hash comparison (suffixes.py),
and neighbours in that order with a common extension of ``length`` bytes, checked byte by byte, are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movewatch.llm import repeats
from movewatch.llm.common import in_slices
from movewatch.llm.suffixes import SuffixOrder
from movewatch.llm.windows import Kind

GRAM = 40


def _in_order(found: repeats.Segments) -> np.ndarray:
    """The windows with an equal one in their group, from the suffix order."""
    data = np.frombuffer(found.tokens.raw, np.uint8)
    classes = SuffixOrder(data, found.hashes, found.kind.window).repeated(found.starts, found.group)
    return np.bincount(classes, minlength=1)[classes] > 1


def _keep(window: int, with_text: bool):
    def one(raw: bytes, low: np.ndarray, high: np.ndarray, copied: bool) -> tuple[int, int, int, bytes]:
        data = np.frombuffer(raw, np.uint8)
        gone = np.ones(len(raw), bool) if copied and len(raw) >= window else repeats.covered(low, high, window, len(raw))
        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        return len(raw), int(gone.sum()), spans, data[~gone].tobytes()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            copied = batch.column(3).to_numpy() > 1
            made = [one(t, *r, c) for t, r, c in zip(texts, repeats.listed_runs(batch.column(4)), copied)]
            size, removed, spans, kept = zip(*made) if made else ((), (), (), ())
            arrays = [pa.array(x, pa.int64()) for x in (size, removed, spans)]
            arrays.append(pa.array([hashlib.sha256(k).digest() for k in kept], pa.binary()))
            names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)
    return run


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = False, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, and its remaining bytes on demand.

    Removed is each byte in a string of ``length`` bytes that also starts anywhere else, in the same
    document or another. Strings never cross documents, and all are judged on the input. Null texts count as
    empty; texts shorter than ``length`` stay as they are; repeated rows are copies of each other. An empty table
    gives an empty one.
    """
    kind = Kind(False, length, min(GRAM, length))
    texts = repeats.distinct_texts(docs)
    runs = repeats.repeated_windows(docs, texts, kind, _in_order, keep_first=False, hot=hot)
    rows = repeats.with_runs(texts, runs).select("k1", "k2", "text", "copies", "runs", "first")
    schema = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 binary" + ", kept binary" * with_text
    results = repeats.to_documents(docs, rows.mapInArrow(in_slices(_keep(length, with_text)), schema))
    return results.withColumn("kept_sha256", F.lower(F.hex("kept_sha256")))
