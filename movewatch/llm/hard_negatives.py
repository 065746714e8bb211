"""Hard negatives: for each anchor and positive, the best rows of other labels that come close to the positive.

Scores are inner products of components cut to integers, so they are exact and ties are real ties. An anchor's
positives are its best rows of its own label. A negative of a positive scored p scores between ``LEAST`` of p and p: these
windows overlap, as the positives lie close together. Their upper limits cut the scores into disjoint slots. A block
keeps the k best rows in each slot, Spark keeps the k best of the blocks, and merging the slots from the lowest up gives
what is best below each limit, which answers every window.

Anchors and rows meet in blocks, ``ROWS`` by ``ANCHORS`` of them, spread by hashes of their numbers: no key, label
or vector can fill a task, and what leaves a block is at most k rows a slot and anchor. The driver sees two counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from movewatch.llm.common import in_slices
from movewatch.session import materialized

POSITIVES, NEGATIVES = 5, 5
#: The lowest score of a negative, as a fraction of its positive's.
LEAST = (4, 5)
#: A component x counts as floor(SCALE * x).
SCALE = 256.0
#: Rows and anchors of a block at most; rows of one that is made for more tasks to work; scores held at once.
ROWS, ANCHORS, FEW_ROWS, TASKS = 65536, 8192, 2048, 64
CELLS = 1 << 22
_LONG = (-(1 << 63), (1 << 63) - 1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors: as doubles where all sums fit them, else as 64-bit integers, cut to their range."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return a.astype(float) @ b.T.astype(float)
    return np.clip(a.astype(object) @ b.T.astype(object), *_LONG).astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group, higher scores first, ties to smaller ids."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    return order[np.arange(len(group)) - np.searchsorted(group, group) < k]


def floor_of(limit: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """The smallest whole score that is at least the fraction ``least`` of a limit."""
    top, whole = least
    return limit - limit // whole * (whole - top) - limit % whole * (whole - top) // whole


def packed(vector: np.ndarray) -> bytes:
    """A vector of whole numbers, two bytes each where that is enough."""
    return vector.astype(np.int16 if np.abs(vector.astype(float)).max(initial=0) < 1 << 15 else np.int64).tobytes()


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), dim), np.int64)
    for size, kind in ((2, np.int16), (8, np.int64)):
        at = [i for i, x in enumerate(rows) if len(x) == size * dim and dim]
        out[at] = np.frombuffer(b"".join([rows[i] for i in at]), kind).reshape(len(at), dim)
    return out


def _by_length(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, pa.Table, pa.Table]]:
    """The two sides of a block, vectors of one length at a time."""
    sides = [(t, t.column("dim").to_numpy()) for t in (left, right)]
    for dim in np.intersect1d(*(d for _, d in sides)).tolist():
        yield dim, *(t.filter(pa.array(d == dim)) for t, d in sides)


def _strips(rows: int, anchors: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, rows))
    return (slice(i, i + step) for i in range(0, anchors, step))


def own_label(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """(anchor, id, score): each anchor's k best rows of its label in a block, rows of its id left out."""
    found = [[np.zeros(0, np.int64)] * 3]
    for dim, base, asking in _by_length(rows, anchors):
        x, y = _vectors(base.column("q"), dim), _vectors(asking.column("q"), dim)
        labels, wanted = base.column("label").to_numpy(), asking.column("label").to_numpy()
        ids, own, number = base.column("id").to_numpy(), asking.column("id").to_numpy(), asking.column("node").to_numpy()
        for label in np.unique(wanted):
            at, who = np.flatnonzero(labels == label), np.flatnonzero(wanted == label)
            for strip in _strips(len(at), len(who)):
                mine = who[strip]
                s = scores(y[mine], x[at])
                other = own[mine][:, None] != ids[at][None, :]
                if len(at) > 2 * k:  # what is below the k-th of all is below the k-th of the others, but for rows of the id
                    cut = np.partition(np.where(other, s, s.min(initial=0)), len(at) - k, axis=1)[:, len(at) - k]
                    other &= s >= cut[:, None]
                i, j = np.nonzero(other)
                score = s[i, j].astype(np.int64)
                keep = best(i, score, ids[at][j], k)
                found.append([number[mine][i[keep]], ids[at][j[keep]], score[keep]])
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names=["anchor", "id", "score"])


def in_slots(rows: pa.Table, anchors: pa.Table, k: int, least: tuple[int, int]) -> pa.Table:
    """(anchor, slot, id, score): the k best rows of other labels in each slot of each anchor in a block.

    Slot 0 holds the scores from the highest limit down to above the next one, and so on; the last goes down to the
    lowest window's end.
    """
    found = [[np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]]
    for dim, base, asking in _by_length(rows, anchors):
        x, y = _vectors(base.column("q"), dim), _vectors(asking.column("q"), dim)
        ids, labels = base.column("id").to_numpy(), base.column("label").to_numpy()
        number, own = asking.column("node").to_numpy(), asking.column("label").to_numpy()
        lists = asking.column("limits").to_pylist()
        limits = np.array([one + one[-1:] * (max(map(len, lists)) - len(one)) for one in lists], np.int64)
        low = floor_of(limits, least).min(axis=1)
        for strip in _strips(len(ids), len(number)):
            s = scores(y[strip], x)
            near = (s <= limits[strip, :1]) & (s >= low[strip, None]) & (own[strip, None] != labels[None, :])
            i, j = np.nonzero(near)
            score = s[i, j].astype(np.int64)
            slot = (limits[strip][i] >= score[:, None]).sum(axis=1) - 1
            # a limit that fills up a shorter list is no slot of its own
            slot = np.minimum(slot, np.array([len(one) - 1 for one in lists[strip]])[i])
            keep = best(i * limits.shape[1] + slot, score, ids[j], k)
            found.append([number[strip][i[keep]], slot[keep].astype(np.int32), ids[j[keep]], score[keep]])
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names=["anchor", "slot", "id", "score"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3).to_pylist()
        dim, q = pa.array([len(x) for x in lists], pa.int32()), pa.array([packed(np.array(x, np.int64)) for x in lists], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], dim, q], ["id", "label", "asks", "dim", "q"])


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def mine(
    df: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: tuple[int, int] = LEAST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row ``is_anchor`` marks.

    Higher scores come first, ties go to the smaller id. Rows with a null id or label, a null vector or a null or
    non-finite component take no part; an empty vector scores 0. Only vectors of one length meet. Of rows that agree in
    all this one counts; rows of one id that differ are candidates and anchors of their own, and none for each other's
    positives. A positive below zero has no negatives, a positive without negatives no rows. Scores beyond 64 bits stand
    at their limit. An empty table gives an empty one.
    """
    v = F.col(vector).cast("array<double>")
    clean = df.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & usable(v)).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        F.transform(v, lambda x: F.floor(F.lit(SCALE) * x)).alias("v"),
    )
    rows = clean.mapInArrow(in_slices(_packed), "id long, label long, asks boolean, dim int, q binary").distinct()
    rows = materialized(rows.withColumn("node", F.monotonically_increasing_id()), "negatives-rows")
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    parts = max(-(-n // ROWS), min(-(-n // FEW_ROWS), TASKS), 1)
    turns = max(-(-asking // ANCHORS), 1)

    def compared(anchors: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        part, turn = (F.pmod(F.xxhash64(F.lit(s), F.col("node")), F.lit(m)).cast("int") for s, m in ((1, parts), (2, turns)))
        dealt = rows.drop("asks").withColumn("part", part).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        asked = anchors.withColumn("turn", turn).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return dealt.groupBy("part", "turn").cogroup(asked.groupBy("part", "turn")).applyInArrow(run, schema)

    anchors = rows.filter("asks").drop("asks")
    order = (F.desc("score"), F.asc("id"))
    found = compared(anchors, lambda base, asked: own_label(base, asked, positives), "anchor long, id long, score long")
    first = Window.partitionBy("anchor").orderBy(*order)
    found = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    held = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("at"), "id", "score")), asc=False).alias("positives"))
    limits = F.sort_array(F.array_distinct(F.col("positives.score")), asc=False)
    asked = anchors.join(held.withColumnRenamed("anchor", "node"), "node").withColumn("limits", limits)
    asked = materialized(asked, "negatives-anchors")
    near = compared(
        asked.drop("positives"), lambda base, asked: in_slots(base, asked, negatives, least), "anchor long, slot int, id long, score long"
    )
    in_slot = Window.partitionBy("anchor", "slot").orderBy(*order)
    near = near.withColumn("place", F.row_number().over(in_slot)).filter(F.col("place") <= negatives)
    slot = F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("rows")
    slots = near.groupBy("anchor", "slot").agg(slot).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "rows"))).alias("slots"))
    # from the lowest slot up: the best below each limit, those of the slot itself before what is best below it
    empty = F.array().cast("array<struct<place:int,id:bigint,score:bigint>>")
    upward = F.sequence(F.size("limits") - 1, F.lit(0), F.lit(-1))
    below = F.aggregate(
        upward,
        F.array(empty),
        lambda made, at: F.concat(F.array(F.slice(F.concat(F.coalesce(F.try_element_at("slots", at), empty), made[0]), 1, negatives)), made),
    )
    merged = asked.join(slots.withColumnRenamed("anchor", "node"), "node").withColumn("below", below)
    each = merged.select(F.col("id").alias("anchor_id"), F.explode("positives").alias("p"), "limits", "below")
    window = F.element_at("below", F.array_position("limits", F.col("p.score")).cast("int"))
    top, whole = least
    score = F.col("p.score")
    lowest = score - F.expr(f"p.score div {whole} * {whole - top} + p.score % {whole} * {whole - top} div {whole}")
    inside = F.filter(window, lambda x: (x["score"] >= lowest) & (score >= 0))
    out = each.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(inside).alias("at", "n"))
    return out.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score")
    )
