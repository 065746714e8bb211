"""Near-duplicate embeddings by Euclidean p-stable hashing, checked by exact cosines.

A hash of a unit vector is its projection on a random Gaussian direction, shifted and cut into steps of ``WIDTH``; a
bucket of a table is ``HASHES`` of them. Unit vectors with a cosine of 0.9 are 0.447 apart and share a given table's bucket
with probability 0.115, so one of the ``TABLES`` tables with 0.98; at 0.92 it is 0.994, at 0.95 0.9997.

Near copies of one text can be a third of all rows and are not paired. In the buckets of the first table, cut into
blocks, vectors within half the threshold's angle of a leader form a class: all its pairs are links. A class is filed
in all its members' buckets, and classes that meet are held against each other by their centres and widths: either all
their pairs are links, or none is, or else their members are compared. A vector alone is a class of width zero.

Rows of a bucket carry a sketch, the first coordinates after a random rotation, cut to bytes: with the rest's length it
bounds the cosine from above, so that whole vectors move only for pairs of classes that pass. Buckets over ``BLOCK`` rows
are cut into blocks, and each pair of blocks is a task's group. Their sizes are estimated from one row in ``SAMPLE``: they
balance the work, no result depends on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewatch.llm.common import in_slices
from movewatch.llm.components import components
from movewatch.operators.joins import lookup
from movewatch.session import materialized

LEAST = 0.9
TABLES, HASHES, WIDTH, SEED = 32, 14, 2.5, 42
BLOCK, SAMPLE = 4096, 16
SKETCH = 32
PAIRWISE, CHUNK_ROWS, CELLS = 64, 1 << 17, 1 << 21
#: Room for rounding in angles, and for the sketch's bytes in a product of two of them.
SLACK = 1e-6
_BYTE = 1 / 127
_SKETCH_SLACK = _BYTE * np.sqrt(SKETCH) + SKETCH * _BYTE**2 / 4 + 1e-5


@lru_cache(4)
def projections(dim: int, tables: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts and the numbers that make a bucket of its hashes, for vectors of a length."""
    rng = np.random.default_rng([seed, dim])
    directions = rng.normal(size=(dim, tables * hashes))
    return directions, rng.uniform(0, WIDTH, tables * hashes), rng.integers(1, 1 << 63, (tables, hashes), np.uint64) | np.uint64(1)


@lru_cache(4)
def rotation(dim: int, seed: int) -> np.ndarray:
    """Orthonormal directions for sketches, at most ``SKETCH``."""
    return np.linalg.qr(np.random.default_rng([seed, dim, 1]).normal(size=(dim, dim)))[0][:, :SKETCH]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def buckets(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED) -> np.ndarray:
    """The bucket of each unit vector in each table."""
    directions, shift, odd = projections(unit.shape[1], tables, hashes, seed)
    steps = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), tables, hashes)
    made = mixed((steps * odd).sum(axis=2, dtype=np.uint64) ^ mixed(np.arange(tables, dtype=np.uint64) + np.uint64(unit.shape[1] << 32)))
    return made.view(np.int64)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with those of y in double precision, after exact scaling."""
    x, y = (v * np.exp2(-np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (x, y))
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def classes(unit: np.ndarray, theta: float) -> list[np.ndarray]:
    """The rows in classes: those left within half of ``theta`` of the first one left, until none is."""
    left, out, near = np.arange(len(unit)), [], np.cos(theta / 2 - SLACK)
    while len(left):
        joins = unit[left] @ unit[left[0]] >= near
        joins[0] = True
        out.append(left[joins])
        left = left[~joins]
    return out


def centre(unit: np.ndarray, theta: float) -> tuple[np.ndarray, float]:
    """The direction in the middle of a class, its first row the leader, and the widest angle to it, at most half of ``theta``."""
    middle = unit.sum(axis=0)
    middle /= np.sqrt((middle * middle).sum())
    wide = float(angle(unit @ middle).max()) + SLACK
    return (middle, wide) if wide <= theta / 2 - SLACK else (unit[0], float(angle(unit @ unit[0]).max()) + SLACK)


def sketched(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading coordinates of unit vectors as bytes, and the length of what they leave out."""
    own = unit @ rotation(unit.shape[1], seed)
    codes = np.zeros((len(unit), SKETCH), np.int8)
    codes[:, : own.shape[1]] = np.rint(own * 127)
    return codes, np.sqrt(np.maximum(0, 1 - (own * own).sum(axis=1)))


def grouped(run: Callable[..., list[np.ndarray]], names: list[str], keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over chunks of whole groups of a stream that is sorted by its first ``keys`` columns.

    ``run`` gets the places where groups start and the chunk, and returns columns.
    """
    def starts(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for c in range(keys):
            own = table.column(c).to_numpy()
            new[1:] |= own[1:] != own[:-1]
        return np.flatnonzero(new)

    def made(first: np.ndarray, table: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in run(first, table)], names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                table = pa.concat_tables(held).combine_chunks()
                first = starts(table)
                if first[-1]:
                    yield made(first[:-1], table.slice(0, first[-1]))
                held, rows = [table.slice(first[-1])], table.num_rows - first[-1]
        if rows:
            table = pa.concat_tables(held).combine_chunks()
            yield made(starts(table), table)
    return stream


def _vectors(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _filed(tables: int, hashes: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            keys: list = [None] * len(lists)
            for dim in {len(x) for x in lists}:
                at = [i for i, x in enumerate(lists) if len(x) == dim]
                for i, own in zip(at, buckets(units(np.array([lists[i] for i in at], float)), tables, hashes, seed)):
                    keys[i] = own
            whole = pa.array([np.array(x, float).tobytes() for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), whole, pa.array(keys, pa.list_(pa.int64()))], ["id", "x", "keys"])
    return run


def _classed(theta: float, seed: int) -> Callable:
    """From a block's rows (key, part, node, id, x, keys): each row's class, and what stands for the class with its leader."""
    def run(first: np.ndarray, table: pa.Table) -> list[np.ndarray]:
        n = table.num_rows
        node, whole = table.column("node").to_numpy(), table.column("x").to_pylist()
        offsets = table.column("keys").combine_chunks().offsets.to_numpy()
        keys = table.column("keys").combine_chunks().flatten().to_numpy()
        offsets = offsets - offsets[0]
        own, total, wide, rest = node.copy(), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        middles, files, codes = [None] * n, [None] * n, [None] * n
        for i, j in zip(first, np.append(first[1:], n)):
            sizes = np.array([len(x) for x in whole[i:j]])
            for size in np.unique(sizes):
                at = i + np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join([whole[a] for a in at]), np.float64).reshape(len(at), -1)
                unit = units(x)
                for members in classes(unit, theta) if len(at) > 1 else [np.zeros(1, np.int64)]:
                    lead, held = at[members[0]], at[members]
                    middle, radius = centre(unit[members], theta) if len(members) > 1 else (unit[members[0]], 0.0)
                    own[held], total[lead], wide[lead] = node[lead], len(members), radius
                    middles[lead] = middle.tobytes() if len(members) > 1 else whole[lead]
                    files[lead] = np.unique(np.concatenate([keys[offsets[a] : offsets[a + 1]] for a in held]))
                    code, left = sketched(middle[None, :], seed)
                    codes[lead], rest[lead] = code.tobytes(), left[0]
        return [node, table.column("id").combine_chunks(), own, total, wide, pa.array(middles, pa.binary()), pa.array(codes, pa.binary()), rest, pa.array(files, pa.list_(pa.int64())), table.column("x").combine_chunks()]
    return run


def _met(theta: float) -> Callable:
    """Pairs of classes of a block (key, low, high, part, cls, total, wide, rest, sketch) that the sketches don't keep apart."""
    def run(first: np.ndarray, table: pa.Table) -> list[np.ndarray]:
        n = table.num_rows
        low, high, part, cls, wide, rest = (table.column(c).to_numpy() for c in ("low", "high", "part", "cls", "wide", "rest"))
        codes = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.int8).reshape(n, SKETCH).astype(np.float32) / np.float32(127)
        size = np.diff(np.append(first, n))
        length, place = np.repeat(size, size), np.arange(n) - np.repeat(first, size)

        def passes(product: np.ndarray, a, b) -> np.ndarray:
            reach = np.minimum(np.pi, theta + wide[a] + wide[b] + SLACK)
            return product + _SKETCH_SLACK + rest[a] * rest[b] >= np.cos(reach)

        found = [np.zeros((2, 0), np.int64)]
        few = np.flatnonzero((length > 1) & (length <= PAIRWISE))
        for step in range(1, int(size[size <= PAIRWISE].max(initial=1))):
            few = few[place[few] + step < length[few]]
            for i in range(0, len(few), CELLS // SKETCH):
                a = few[i : i + CELLS // SKETCH]
                a = a[(low[a] == high[a]) | (part[a] != part[a + step])]
                a = a[passes((codes[a] * codes[a + step]).sum(axis=1), a, a + step)]
                found.append(cls[np.stack((a, a + step))])
        for i, count in zip(first[size > PAIRWISE], size[size > PAIRWISE]):
            at = np.arange(i, i + count)
            left, right = (at[part[at] == low[i]], at[part[at] == high[i]]) if low[i] != high[i] else (at, at)
            step = max(1, CELLS // max(1, len(right)))
            for s in range(0, len(left), step):
                a = left[s : s + step, None]
                p, q = np.nonzero(passes(codes[a[:, 0]] @ codes[right].T, a, right[None, :]))
                p, q = a[p, 0], right[q]
                found.append(cls[np.stack((p, q))[:, p < q] if low[i] == high[i] else np.stack((p, q))])
        pairs = np.concatenate(found, axis=1)
        pairs = np.unique(np.sort(pairs[:, pairs[0] != pairs[1]], axis=0), axis=1)
        return [pairs[0], pairs[1]]
    return run


def _judged(theta: float, least: float) -> Callable:
    """Whether all pairs of two classes (a, b, their centres, widths) are links (1), none (dropped), or some may be (0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, u, v, wide, wider = (batch.column(i) for i in range(6))
            dims = np.array([len(x) // 8 for x in u.to_pylist()])
            kind = np.full(len(dims), -1, np.int32)
            reach = wide.to_numpy() + wider.to_numpy()
            same = dims == np.array([len(x) // 8 for x in v.to_pylist()])
            for dim in np.unique(dims[same]):
                at = np.flatnonzero(same & (dims == dim))
                cos = cosines(_vectors(u.take(pa.array(at)), dim), _vectors(v.take(pa.array(at)), dim))
                apart, spread = angle(cos), reach[at]
                between = np.where(apart + spread + SLACK <= theta, 1, np.where(apart - spread - SLACK > theta, -1, 0))
                kind[at] = np.where(spread == 0, np.where(cos >= least, 1, -1), between)
            keep = pa.array(kind >= 0)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(kind[kind >= 0])], ["a", "b", "kind"])
    return run


def _members(least: float) -> Callable:
    """Links of each member of two classes to the other's, from a group (a, b, node, cls, x)."""
    def run(group: pa.Table) -> pa.Table:
        a, b, node, cls = (group.column(c).to_numpy() for c in ("a", "b", "node", "cls"))
        whole = group.column("x").to_pylist()
        x = np.frombuffer(b"".join(whole), np.float64).reshape(len(whole), -1)
        one, two = np.flatnonzero(cls == a[0]), np.flatnonzero(cls == b[0])
        links = np.zeros(len(node), np.int64)
        unit = units(x)
        step = max(1, CELLS // max(1, len(two)))
        for s in range(0, len(one), step):
            mine = one[s : s + step]
            cos = unit[mine] @ unit[two].T
            near = cos >= least
            i, j = np.nonzero(np.abs(cos - least) < 1e-9)  # too close for the product's rounding
            near[i, j] = cosines(x[mine[i]], x[two[j]]) >= least
            links[mine] += near.sum(axis=1)
            links[two] += near.sum(axis=0)
        some = links > 0
        return pa.table([pa.array(v[some]) for v in (node, links, a, b)], names=["node", "links", "a", "b"])
    return run


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = LEAST, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links to other rows, the smallest id reachable, whether it is the own.

    Rows are linked if the cosine of their vectors, in double precision, is at least ``least``; found with the probability
    stated above, and none below is linked. Rows with equal ids are different rows. Vectors that are null, empty, all zero or
    hold a null or non-finite component have no links, nor have vectors of different lengths. Null ids are passed over for the
    smallest; a component of null ids only has a null and all its rows are kept. An empty table gives an empty one.
    """
    theta = float(np.arccos(least))
    v = F.col(vector).cast("array<double>")
    asked = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    whole = asked.filter(F.coalesce(usable(F.col("v")), F.lit(False)))
    rows = whole.mapInArrow(in_slices(_filed(tables, hashes, seed)), "id long, x binary, keys array<long>")
    rows = materialized(rows.withColumn("node", F.monotonically_increasing_id()), "vectors")

    sampled = rows.filter(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("key"))
    large = sampled.groupBy("key").count().filter(F.col("count") * SAMPLE > BLOCK)
    large = materialized(large.select("key", F.ceil(F.col("count") * SAMPLE / BLOCK).cast("int").alias("parts")), "large-buckets")

    def in_parts(rows: DataFrame, number: str) -> DataFrame:
        parts = F.coalesce("parts", F.lit(1))
        part = F.pmod(F.xxhash64(F.lit(4), number), parts).cast("int")
        return lookup(rows, large, ["key"], number, "left").withColumn("parts", parts).withColumn("part", part)

    blocks = in_parts(rows.withColumn("key", F.col("keys")[0]), "node").select("key", "part", "node", "id", "x", "keys")
    blocks = blocks.repartition("key", "part").sortWithinPartitions("key", "part")
    names = ["node", "id", "cls", "total", "wide", "centre", "sketch", "rest", "files", "x"]
    schema = "node long, id long, cls long, total long, wide double, centre binary, sketch binary, rest double, files array<long>, x binary"
    members = materialized(blocks.mapInArrow(grouped(_classed(theta, seed), names, 2), schema), "vector-classes")

    leaders = members.filter("total > 0")
    filed = in_parts(leaders.select(F.explode("files").alias("key"), "cls", "wide", "rest", "sketch"), "cls")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    spread = filed.select("*", other).select(
        "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "cls", "wide", "rest", "sketch"
    )
    meeting = spread.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    pairs = materialized(meeting.mapInArrow(grouped(_met(theta), ["a", "b"], 3), "a long, b long").distinct(), "vector-pairs")

    centres = leaders.select("cls", "centre", "wide")
    one = lookup(pairs, centres.toDF("a", "u", "wide"), ["a"], "b")
    both = lookup(one, centres.toDF("b", "v", "wider"), ["b"], "a").select("a", "b", "u", "v", "wide", "wider")
    judged = materialized(both.mapInArrow(in_slices(_judged(theta, least)), "a long, b long, kind int"), "vector-judged")
    linked = judged.filter("kind = 1").select("a", "b")
    unsure = judged.filter("kind = 0").select("a", "b")
    sides = unsure.select("a", "b", F.explode(F.array("a", "b")).alias("cls"))
    apart = lookup(sides, members.select("node", "cls", "x"), ["cls"], F.struct("a", "b"))
    partly = materialized(apart.groupBy("a", "b").applyInArrow(_members(least), "node long, links long, a long, b long"), "vector-members")

    totals = leaders.select("cls", "total")
    ways = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = lookup(ways, totals.toDF("b", "total"), ["b"], "a").groupBy(F.col("a").alias("cls")).agg(F.sum("total").alias("beside"))
    single = partly.groupBy("node").agg(F.sum("links").alias("single"))
    roots = components(linked.unionByName(partly.select("a", "b").distinct()).toDF("u", "v")).toDF("cls", "root")
    rooted = leaders.select("cls", "total").join(beside, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    firsts = members.groupBy("cls").agg(F.min("id").alias("first"))
    named = rooted.join(firsts, "cls")
    least_of = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = lookup(named, least_of, ["root"], "cls").select("cls", (F.col("total") - 1 + F.coalesce("beside", F.lit(0))).alias("n"), "component_id")
    met = members.select("node", "id", "cls").join(named, "cls").join(single, "node", "left")
    met = met.select(F.col("id").alias("vec_id"), (F.col("n") + F.coalesce("single", F.lit(0))).alias("n_links"), "component_id")
    alone = asked.filter(~F.coalesce(usable(F.col("v")), F.lit(False)))
    alone = alone.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
