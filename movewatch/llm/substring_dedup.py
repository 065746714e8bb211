"""Substring deduplication with fixed-block anchors: words in a passage that occurs earlier are removed.

Reference blocks are the non-overlapping runs of ``block`` words of each passage, indexed by hash. Every rolling
window of as many words probes the index. A window of at least 2 * block - 1 words holds a whole block, so
a repeat has at least one hit in either place; hits are extended to all windows around them, and windows
with the same words are joined into maximal repeats. Which passages can have hits at all is found
beforehand by anchors (repeats.py), so that the rolling probes stay where the repeats are.
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
from movewatch.llm.windows import Kind, mix
from movewatch.session import materialized

GRAM = 6
_U = np.uint64


def _by_blocks(found: repeats.Segments) -> np.ndarray:
    """The windows with an equal, earlier one in their group."""
    codes, window = found.tokens.codes, found.kind.window
    block = (window + 1) // 2
    begins = found.tokens.begins
    if not len(found.starts):
        return np.zeros(0, bool)
    groups = np.zeros(len(begins) - 1, np.int64)
    groups[found.segment] = found.group
    rolling = mix(found.hashes.every(block))
    # the index: blocks at multiples of the block length from each passage's start
    sizes = np.diff(begins)
    blocks = sizes // block
    owner = np.repeat(np.arange(len(blocks)), blocks)
    at = begins[owner] + block * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    key = lambda place, own: mix(rolling[place] ^ groups[own].astype(_U) * _U(0x9E3779B97F4A7C15))
    index = np.unique(key(at, owner))
    # every rolling probe, and how often its words were probed: a lone hit is a block meeting itself
    count = np.maximum(0, sizes - block + 1)
    own = np.repeat(np.arange(len(count)), count)
    probe = begins[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    asked, inverse, times = np.unique(key(probe, own), return_inverse=True, return_counts=True)
    slot = np.minimum(np.searchsorted(index, asked), len(index) - 1)
    hit = ((index[slot] == asked) & (times > 1))[inverse]
    # extension: the windows that hold a hit
    marks = np.zeros(len(codes) + 1, np.int64)
    marks[probe[hit] + 1] = 1
    marks = np.cumsum(marks)
    open_ = np.flatnonzero(marks[found.starts + window - block + 1] > marks[found.starts])
    starts = found.starts[open_]
    code = mix(found.hashes.of(starts, window) ^ found.group[open_].astype(_U) * _U(0x9E3779B97F4A7C15))
    order = np.lexsort((found.order[open_], code))
    new = np.concatenate(([True], code[order][1:] != code[order][:-1])) if len(order) else np.zeros(0, bool)
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.flatnonzero(~new)
    # equal hashes are checked word by word: a number stands for each different word
    numbers: dict[bytes, int] = {}
    spelt = np.array([numbers.setdefault(w, len(numbers)) for w in found.tokens.raw.split()], np.int64)
    words = np.lib.stride_tricks.sliding_window_view(spelt, window)
    for i in range(0, len(later), 1 << 15):
        part = later[i : i + (1 << 15)]
        new[part] = (words[starts[order[part]]] != words[starts[first[part]]]).any(axis=1)
    removed = np.zeros(len(found.starts), bool)
    removed[open_[order[~new]]] = True
    return removed


def _keep(window: int, with_text: bool):
    def one(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple:
        words = text.split()
        whole = b" ".join(words)
        gone = repeats.covered(low, high, window, len(words))
        kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if gone.any() else whole
        later = len(words) if len(words) >= window else 0  # a copy of an earlier document loses all its windows
        return len(words), int(gone.sum()), kept, later, b"" if later else whole

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            made = [one(t, *r) for t, r in zip(texts, repeats.listed_runs(batch.column(4)))]
            n, removed, kept, later, rest = zip(*made) if made else ((),) * 5
            arrays = [batch.column(0), batch.column(1), batch.column(3), pa.array(n, pa.int64())]
            for gone, left in ((removed, kept), (later, rest)):
                fields = [pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).digest() for k in left], pa.binary())]
                fields += [pa.array([k.decode("utf-8", "replace") for k in left], pa.string())] * with_text
                arrays.append(pa.StructArray.from_arrays(fields, ["n_removed", "kept_sha256", "kept"][: len(fields)]))
            yield pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "first", "n_words", "own", "copy"])
    return run


def remove_later(docs: DataFrame, words: int = 20, with_text: bool = False, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document, and its remaining words on demand.

    Removed is each word in a run of ``words`` words whose like starts earlier: in a document with a smaller id,
    or in the same one. Null ids come last; documents that share an id but not their text come in the order of
    their texts' hashes; rows that repeat id and text count as one document. Null texts have no words. An empty table
    gives an empty one.
    """
    kind = Kind(True, words, min(GRAM, words))
    texts = repeats.distinct_texts(docs)
    runs = repeats.repeated_windows(docs, texts, kind, _by_blocks, keep_first=True, hot=hot)
    # the compared tokens leave the disk before the texts are moved again
    runs = materialized(runs, "runs")
    rows = repeats.with_runs(texts, runs).select("k1", "k2", "text", "first", "runs", "copies")
    fields = "struct<n_removed:long,kept_sha256:binary" + ",kept:string" * with_text + ">"
    results = rows.mapInArrow(in_slices(_keep(words, with_text)), f"k1 long, k2 long, first long, n_words long, own {fields}, copy {fields}")
    found = repeats.to_documents(docs, results)
    earliest = F.coalesce(F.col("doc_id").cast("long"), F.lit(repeats.LAST)) == F.col("first")
    return found.select("doc_id", "n_words", F.when(earliest, F.col("own")).otherwise(F.col("copy")).alias("r")).select("doc_id", "n_words", "r.*").withColumn("kept_sha256", F.lower(F.hex("kept_sha256")))
