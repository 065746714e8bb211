"""Windows of a corpus that occur more than once, found without moving texts that hold none.

1. Every text is stood for by the anchors of its windows (windows.py). Anchors whose gram occurs only once in the
   corpus drop out; with them go all windows they stand for.
2. Anchors that agree in gram and in the hash of all tokens their windows cover are taken for copies of each other, window
   by window. Their tokens are sent and compared, in blocks that each hold the first of them in document order, so
   that a passage with any number of copies is spread over tasks. The first one goes on for all of them.
3. What is left are first anchors whose gram also occurs in other surroundings: the ends of repeated passages.
   Their tokens are sent, grouped by gram, and their windows compared within the group. A gram with
   many surroundings is cut into parts by the windows' distance from the anchor, since equal windows have
   equal distance; of one with over ``HOT``, windows whose hash occurs once drop out, and the others are compared
   as in step 2, each window by itself.

Hashes only bring together what is compared: every removed window was found equal to another by ``removed``, the operator's own
method, token by token. Step 1 handles a few numbers an anchor. Every count is an aggregate with a map side, and
rows are joined to them with salted keys, so one gram may hold most of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewatch.llm.common import content_key, in_slices
from movewatch.llm.windows import BASES, Kind, PrefixHashes, Tokens, anchors, batches, span_codes, window_starts
from movewatch.operators.joins import lookup
from movewatch.session import materialized

SALTS = 2
#: Surroundings of a gram up to which its windows are compared in one part, the windows a part has beyond, and the
#: number beyond which windows that can't have an equal are sorted out first.
WHOLE, PART_WINDOWS, HOT = 256, 32, 1 << 16
#: Copies of a passage that are compared together.
COPIES = 512
#: Tokens of a text, as a power of two, whose copies elsewhere are compared together.
STRETCH_BITS = 10
#: Bits of each of the two distances in a packed place.
DISTANCE = 16
CHUNK_BYTES = 1 << 20
LAST = (1 << 63) - 1  # the order of a document without an id

#: (numbers of groups, texts' order, segments) -> per window whether it is removed; see ``Segments``.
Compare = Callable[["Segments"], np.ndarray]


class Segments:
    """The tokens of some anchors' windows, whole groups only, ready to compare.

    ``starts`` are the places of all windows, ``group`` their groups, ``order`` a sortable rank of their
    occurrences (document, then place), ``segment`` the anchor each is from.
    """

    def __init__(self, kind: Kind, group: np.ndarray, rank: list[np.ndarray], low: np.ndarray, texts: list[bytes]):
        self.kind, self.tokens = kind, kind.tokens(texts)
        self.hashes = PrefixHashes(self.tokens.codes)
        self.starts, self.segment = window_starts(self.tokens.begins, kind.window)
        self.group = group[self.segment]
        self.place = low[self.segment] + self.starts - self.tokens.begins[self.segment]
        place_order = np.lexsort((self.place, *(r[self.segment] for r in reversed(rank))))
        self.order = np.empty(len(place_order), np.int64)
        self.order[place_order] = np.arange(len(place_order))
        self.low = low


def distinct_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, text, copies, first): one row for each different text; ``first`` is the smallest id, null last."""
    k1, k2 = content_key(F.col(text))
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("first"))
    return rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.min("first").alias("first"))


def _utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _anchors(kind: Kind, brief: bool):
    """Anchors of a stream of (k1, k2, first, text): gram hashes only, or with span hash and place."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = _utf8(batch.column(3))
            keys = [batch.column(i).to_numpy() for i in range(3)]
            for i, j in batches(texts):
                tokens = kind.tokens(texts[i:j])
                hashes = PrefixHashes(tokens.codes)
                found = anchors(kind, tokens, hashes)
                gram = pa.array(found.gram.view(np.int64))
                if brief:
                    yield pa.RecordBatch.from_arrays([gram], ["g"])
                    continue
                span = span_codes(kind, PrefixHashes(tokens.codes, BASES[1]), found)
                place = ((found.at - tokens.begins[found.text]) << DISTANCE | (found.at - found.first)) << DISTANCE | (found.last - found.first)
                own = [pa.array(k[i:j][found.text]) for k in keys]
                yield pa.RecordBatch.from_arrays([gram, pa.array(span.view(np.int64)), *own, pa.array(place)], ["g", "s", "k1", "k2", "first", "place"])
    return run


_FAR = (1 << DISTANCE) - 1


def _ends(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of a packed place."""
    first = (place >> 2 * DISTANCE) - (place >> DISTANCE & _FAR)
    return first, first + (place & _FAR)


def _listed(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's entries begin, and the entries' fields."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], [f.to_numpy() for f in column.flatten().flatten()]


def _segments(kind: Kind, hot: int):
    """The tokens of the listed anchors of each text: ends cut into parts, copies whole."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = _utf8(batch.column(3))
            keys = [batch.column(i).to_numpy() for i in range(3)]
            offsets, (gram, place, spans, block) = _listed(batch.column(4))
            for i, j in batches(texts):
                own = slice(offsets[i], offsets[j])
                owner = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
                tokens = kind.tokens(texts[i:j])
                copy = block[own] >= 0
                for cut, chosen in ((_whole, np.flatnonzero(copy)), (_parts, np.flatnonzero(~copy & (spans[own] <= hot)))):
                    if len(chosen):
                        fields = [f[own][chosen] for f in (gram, place, spans, block)]
                        yield cut(kind, tokens, [k[i:j] for k in keys], owner[chosen], *fields)
    return run


def _crowded(kind: Kind):
    """A row for each window of the listed anchors of each text: two hashes of it, and where it is."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = _utf8(batch.column(3))
            keys = [batch.column(i).to_numpy() for i in range(3)]
            offsets, (place,) = _listed(batch.column(4))
            for i, j in batches(texts):
                owner = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
                yield _single(kind, texts[i:j], [k[i:j] for k in keys], owner, place[offsets[i] : offsets[j]])
    return run


def _single(kind: Kind, texts, keys, owner, place) -> pa.RecordBatch:
    """A row for each window: two hashes of it, and where it is."""
    tokens = kind.tokens(texts)
    first, last = _ends(place)
    count = last - first + 1
    row = np.repeat(np.arange(len(place)), count)
    low = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = low + tokens.begins[owner[row]]
    codes = [PrefixHashes(tokens.codes, b).of(start, np.int64(kind.window)).view(np.int64) for b in BASES]
    # a window's place is that of an anchor that stands for it alone
    arrays = [*codes, *(k[owner[row]] for k in keys), low << 2 * DISTANCE]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["g", "s", "k1", "k2", "first", "place"])


def _rows(kind: Kind, tokens: Tokens, keys, owner, gram, part, low, windows) -> pa.RecordBatch:
    """Segments of ``windows`` windows from ``low`` on, with their tokens."""
    start = low + tokens.begins[owner]
    end = start + windows - 1 + kind.window
    byte_from, byte_to = (start, end) if tokens.byte_from is None else (tokens.byte_from[start], tokens.byte_to[end - 1])
    raw = [tokens.raw[a:b] for a, b in zip(byte_from.tolist(), byte_to.tolist())]
    arrays = [gram, part.astype(np.int32), *(k[owner] for k in keys), low]
    return pa.RecordBatch.from_arrays([*(pa.array(a) for a in arrays), pa.array(raw, pa.binary())], ["g", "part", "k1", "k2", "first", "low", "raw"])


def _whole(kind: Kind, tokens: Tokens, keys, owner, gram, place, spans, block) -> pa.RecordBatch:
    """The tokens of the anchors' windows, those that follow each other in a text and go to one block in one piece."""
    first, last = _ends(place)
    order = np.lexsort((first, block, gram, owner))
    owner, gram, block, first, last = owner[order], gram[order], block[order], first[order], last[order]
    same = (owner[1:] == owner[:-1]) & (gram[1:] == gram[:-1]) & (block[1:] == block[:-1]) & (first[1:] <= last[:-1] + 1)
    head = np.flatnonzero(np.concatenate(([True], ~same)))
    end = np.maximum.reduceat(last, head)
    return _rows(kind, tokens, keys, owner[head], gram[head], block[head], first[head], end - first[head] + 1)


def _parts(kind: Kind, tokens: Tokens, keys, owner, gram, place, spans, block) -> pa.RecordBatch:
    """The tokens of each anchor's windows, cut by distance from the anchor where its gram has many surroundings."""
    at = place >> 2 * DISTANCE
    first, last = _ends(place)
    wide = np.where(spans > WHOLE, PART_WINDOWS, 1 << DISTANCE)
    nearest, farthest = at - last, at - first
    parts = farthest // wide - nearest // wide + 1
    row = np.repeat(np.arange(len(place)), parts)
    part = nearest[row] // wide[row] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    far = np.minimum(farthest[row], (part + 1) * wide[row] - 1)
    near = np.maximum(nearest[row], part * wide[row])
    return _rows(kind, tokens, keys, owner[row], gram[row], part, at[row] - far, far - near + 1)


def _compare(kind: Kind, removed: Compare):
    """Runs of removed windows of a stream of segments sorted by (g, part), a chunk of whole groups at a time."""
    def emit(table: pa.Table) -> pa.RecordBatch:
        g, part, k1, k2, first, low = (table.column(i).to_numpy() for i in range(6))
        group = np.cumsum(np.concatenate(([True], (g[1:] != g[:-1]) | (part[1:] != part[:-1]))))
        found = Segments(kind, group, [first, k1, k2], low, table.column(6).to_pylist())
        gone = removed(found)
        at, own = found.starts[gone], found.segment[gone]
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]))) if len(at) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        place, own = found.place[gone], own[heads]
        tails = np.append(heads[1:], len(at)) - 1 if len(heads) else heads
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[own], k2[own], place[heads], place[tails])], ["k1", "k2", "low", "high"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in stream:
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                table = pa.concat_tables(held).combine_chunks()
                g, part = table.column(0).to_numpy(), table.column(1).to_numpy()
                done = int(np.argmax((g == g[-1]) & (part == part[-1])))
                if done:
                    yield emit(table.slice(0, done))
                held = [table.slice(done)]
                size = held[0].nbytes if done else 0
        if held:
            yield emit(pa.concat_tables(held).combine_chunks())
    return run


def repeated_windows(docs: DataFrame, texts: DataFrame, kind: Kind, removed: Compare, keep_first: bool, hot: int = HOT) -> DataFrame:
    """(k1, k2, runs): for each different text the runs (first and last window) of windows to be removed.

    ``texts`` are ``distinct_texts(docs)``. With ``keep_first`` a window is removed if an equal one comes earlier, by
    document id (null last; documents with one id by their texts' hashes) and place; else if there is any other one.
    Copies of a whole text aren't counted here: the caller knows them from ``copies``.
    """
    if kind.reach > _FAR:
        raise ValueError(f"a window may have {_FAR} grams at most")
    k1, k2 = content_key(F.col("text"))
    first = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) if keep_first else F.lit(0).cast("long")
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), first.alias("first"), F.coalesce("text", F.lit("")).alias("text"))
    often = rows.mapInArrow(in_slices(_anchors(kind, True)), "g long").groupBy("g").count().filter("count > 1").select("g")
    placed = rows.mapInArrow(in_slices(_anchors(kind, False)), "g long, s long, k1 long, k2 long, first long, place long")
    shared = lookup(placed, often, ["g"], "k1", "left_semi", SALTS)
    shared = materialized(shared.groupBy("g", "s", "k1", "k2", "place").agg(F.min("first").alias("first")), "anchors")

    spans = materialized(shared.groupBy("g", "s").agg(F.count("*").alias("n"), F.min(_occurrence()).alias("head")), "spans")
    copies = _in_blocks(shared, spans, 0)
    grams = spans.groupBy("g").agg(F.count("*").alias("spans")).filter("spans > 1")
    ends = lookup(spans, grams, ["g"], "s", "inner", SALTS).select("g", "head.k1", "head.k2", "head.place", "spans", F.lit(-1).alias("block"))
    ends = materialized(ends, "ends")
    # all columns of the texts, used or not: as the same exchange it is made once for all joins of texts
    cut = texts.join(_by_text(ends.unionByName(copies)), ["k1", "k2"]).select("k1", "k2", "first", "text", "listed", "copies")
    segments = cut.mapInArrow(in_slices(_segments(kind, hot)), _SEGMENT)

    crowd = ends.filter(F.col("spans") > hot)
    if not crowd.isEmpty():
        listed = crowd.groupBy("k1", "k2").agg(F.collect_list(F.struct("place")).alias("listed"))
        single = texts.join(listed, ["k1", "k2"]).select("k1", "k2", "first", "text", "listed", "copies")
        single = single.mapInArrow(in_slices(_crowded(kind)), "g long, s long, k1 long, k2 long, first long, place long")
        windows = materialized(single.select("g", "s", "k1", "k2", "place", "first" if keep_first else F.lit(0).cast("long").alias("first")), "windows")
        again = _in_blocks(windows, windows.groupBy("g", "s").agg(F.count("*").alias("n"), F.min(_occurrence()).alias("head")), 1)
        beside = texts.join(_by_text(again), ["k1", "k2"]).select("k1", "k2", "first", "text", "listed", "copies")
        segments = segments.unionByName(beside.mapInArrow(in_slices(_segments(kind, hot)), _SEGMENT))

    by_gram = segments.repartition("g", "part").sortWithinPartitions("g", "part")
    runs = by_gram.mapInArrow(in_slices(_compare(kind, removed)), "k1 long, k2 long, low long, high long")
    return runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("runs"))


_SEGMENT = "g long, part int, k1 long, k2 long, first long, low long, raw binary"


def _occurrence() -> Column:
    return F.struct("first", "k1", "k2", "place")


def _in_blocks(rows: DataFrame, spans: DataFrame, step: int) -> DataFrame:
    """The rows (g, s, k1, k2, first, place) of every span that occurs more than once, in blocks of about ``COPIES``; the
    first one of a span is in all its blocks.

    Spans whose first occurrences lie in one stretch of a text go together, so that a passage is sent in one piece. ``step``
    keeps rows of two calls apart: a window that came twice would be its own copy.
    """
    copied = lookup(rows, spans.filter("n > 1"), ["g", "s"], "k1", "inner", SALTS)
    # a power of two, so that the spans of a passage mostly agree in it
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") / COPIES, F.lit(1.0))))).cast("int")
    together = F.xxhash64(F.lit(step), "head.k1", "head.k2", F.shiftright("head.place", 2 * DISTANCE + STRETCH_BITS), blocks)
    own = F.pmod(F.xxhash64(F.lit(9), "k1", "k2"), blocks).cast("int")
    block = F.when(_occurrence() == F.col("head"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    return copied.select(together.alias("g"), "k1", "k2", "place", F.col("n").alias("spans"), F.explode(block).alias("block"))


def _by_text(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "place", "spans", "block")).alias("listed"))


def covered(low: np.ndarray, high: np.ndarray, window: int, tokens: int) -> np.ndarray:
    """Whether each token of a text lies in a window of the runs."""
    change = np.zeros(tokens + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high + window, -1)
    return np.cumsum(change[:-1]) > 0


def listed_runs(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The runs of each row of a ``runs`` column, null as none."""
    offsets = column.offsets.to_numpy()
    low, high = (f.to_numpy() for f in column.flatten().flatten())
    offsets = offsets - offsets[0]
    return [(low[i:j], high[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]


def with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """``texts`` with their runs, an empty list where there are none."""
    none = F.array().cast("array<struct<low:long,high:long>>")
    return texts.join(runs, ["k1", "k2"], "left").withColumn("runs", F.coalesce("runs", none))


def to_documents(docs: DataFrame, results: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and the results of each document's text."""
    k1, k2 = content_key(F.col("text"))
    return lookup(docs.select(key, k1.alias("k1"), k2.alias("k2")), results, ["k1", "k2"], key, "inner", SALTS).drop("k1", "k2")
