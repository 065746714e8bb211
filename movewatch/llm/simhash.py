"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint has 64 bits, each the majority over the hashes of a text's word shingles. Two are linked if at
most ``BUDGET`` = 2 bits differ. Their bits are cut into three segments on a ring. If two bits differ in all,
some segment starts a chain whose running differences stay within 2/3 a segment: none in the first, at most one
in the first two, at most two in all. A bucket is a first segment together with one half of the second one (of
which a single difference leaves one half alone), so every linked pair shares one of six buckets of
about 32 bits. Within a bucket the chain is checked before the full Hamming distance.

Pairs never leave a task: each task joins the links it finds into trees and emits one link a fingerprint. Buckets
above ``PAIRWISE`` fingerprints, as large groups of near copies make them, aren't paired at all: their members are
grouped by what is left when two free bits are blotted out, for every two, which is linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewatch.llm.common import free_name, in_slices
from movewatch.llm.components import components, local_roots
from movewatch.operators.joins import lookup
from movewatch.session import materialized

BUDGET = 2
PAIRWISE = 64
#: (lowest bit, width) of the segments, in ring order.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CHUNK_ROWS = 1 << 18


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of a text as a signed 64-bit number; 0 for a text without words, null included."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = [e + i for i, e in enumerate(accumulate(map(len, found)))]
    span = min(words, len(found))
    starts = [0, *(e + 1 for e in ends[: len(found) - span])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[span - 1 :])], dtype=">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, words: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t, words) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], [*batch.schema.names[1:], "fp"])

    narrow = df.select(F.col(text).alias(free_name(df, "_text")), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])
    return narrow.mapInArrow(in_slices(run), f"{schema}, fp long")


def _bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def buckets(fp: Column) -> Column:
    """The six bucket keys of a fingerprint: chain start and half in the lowest three bits."""
    keys = []
    for i, (low, width) in enumerate(SEGMENTS):
        second, wide = SEGMENTS[(i + 1) % 3]
        cut = wide // 2
        for half, (at, size) in enumerate(((second, cut), (second + cut, wide - cut))):
            key = F.shiftleft(_bits(fp, low, width), 15).bitwiseOR(F.shiftleft(_bits(fp, at, size), 3))
            keys.append(key.bitwiseOR(F.lit(2 * i + half).cast("long")))
    return F.array(*keys)


def _second(start: np.ndarray) -> np.ndarray:
    """The mask of the segment after the chain's first, for each chain start."""
    masks = [((1 << SEGMENTS[(i + 1) % 3][1]) - 1) << SEGMENTS[(i + 1) % 3][0] for i in range(3)]
    return np.array(masks, np.uint64)[start]


def _free_bits(key: int) -> list[int]:
    """The bits that a bucket does not fix."""
    start, half = (key & 7) // 2, key & 1
    low, width = SEGMENTS[start]
    second, wide = SEGMENTS[(start + 1) % 3]
    cut = wide // 2
    fixed = {*range(low, low + width), *(range(second, second + cut) if half == 0 else range(second + cut, second + wide))}
    return [b for b in range(64) if b not in fixed]


def bucket_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (as trees: member, root) between fingerprints of the same bucket. Sorted by key; whole buckets."""
    fp = fp.view(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    length = np.repeat(size, size)
    left, right = [], []
    paired = np.flatnonzero((length > 1) & (length <= PAIRWISE))
    place = np.arange(len(key)) - np.repeat(first, size)
    for step in range(1, int(size[size <= PAIRWISE].max(initial=1))):
        a = paired[place[paired] + step < length[paired]]
        differ = fp[a] ^ fp[a + step]
        chain = np.bitwise_count(differ & _second((key[a] & 7) // 2)) <= 1
        a, differ = a[chain], differ[chain]
        a = a[np.bitwise_count(differ) <= BUDGET]
        left.append(a)
        right.append(a + step)
    for start, count in zip(first[size > PAIRWISE], size[size > PAIRWISE]):
        own = fp[start : start + count]
        for x, y in combinations(_free_bits(int(key[start])), 2):
            rest = own & ~np.uint64((1 << x) | (1 << y))
            order = np.argsort(rest, kind="stable")
            same = np.flatnonzero(rest[order][1:] == rest[order][:-1])
            left.append(start + order[same])
            right.append(start + order[same + 1])
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    nodes, at = np.unique(np.concatenate((fp[left], fp[right])), return_inverse=True)
    root = local_roots(len(nodes), at[: len(left)], at[len(left) :])
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[member].view(np.int64), nodes[root[member]].view(np.int64)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a stream sorted by bucket, a chunk of whole buckets at a time."""
    def emit(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in bucket_links(key, fp)], ["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            key, fp = (np.concatenate(x) for x in zip(*held))
            done = int(np.searchsorted(key, key[-1]))
            if done:
                yield emit(key[:done], fp[:done])
            held, rows = [(key[done:], fp[done:])], len(key) - done
    if rows:
        yield emit(*(np.concatenate(x) for x in zip(*held)))


def groups(prints: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint in ``prints`` that is not the smallest of its group."""
    rows = prints.select("fp").distinct().select(F.explode(buckets(F.col("fp"))).alias("key"), "fp")
    links = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_link, "u long, v long")
    return components(links).select(F.col("node").alias("fp"), "root")


def near_duplicates(df: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``fp`` and ``component_id``: the smallest doc_id reachable over links, the row's own included.

    Null ids are passed over for the smallest; a component of null ids only has a null. Texts without words, nulls
    included, have fingerprint 0, which is linked like any other. An empty table gives an empty one.
    """
    prints = materialized(fingerprints(df, words, keep=keep), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = firsts.join(groups(prints), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = lookup(rooted.select("fp", "root"), ids, ["root"], "fp").select("fp", "component_id")
    return lookup(prints, named, ["fp"], "doc_id")


# --- near copies in the wide sense: a similarity rather than a few bits ---

#: Words of a wide fingerprint, and the differing bits up to which two are linked. Sets of shingles with a Jaccard
#: similarity s differ in about arccos(2 s / (1 + s)) / pi of the bits: 39 of 256 for 0.8; spread about 6; 60 leaves room for chance.
WIDE, WIDE_BUDGET = 4, 60
#: Bits of a segment by which candidates meet, three to a word, and how many of its least certain bits each side may flip.
KEY_BITS, FLIPS = 21, 3
ALL_PAIRS = 1024
_SALTS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SEGMENTS = np.arange(WIDE * (64 // KEY_BITS))[:, None]
_VALUES = 1 << np.arange(KEY_BITS - 1, -1, -1)
_SUBSETS = np.array([[m >> i & 1 for m in range(1 << FLIPS)] for i in range(FLIPS)])


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; of the whole text if it has fewer words."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = [e + i for i, e in enumerate(accumulate(map(len, found)))]
    span = min(words, len(found))
    starts = [0, *(e + 1 for e in ends[: len(found) - span])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[span - 1 :])], np.uint64))


def wide_print(text: str | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The wide fingerprint of a text (``WIDE`` numbers) and its candidate keys, from its distinct shingles.

    A bit is as certain as its majority is large. In each segment the least certain bits are flipped in every
    combination, so two texts meet if in some segment each bit that differs is among those of either.
    """
    return _wide_print(shingles(text, words))


def _wide_print(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes):
        return np.zeros(WIDE, np.uint64), np.zeros(1, np.int64)
    mixed = hashes[:, None] ^ _SALTS
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(29)).astype(">u8")
    margin = 2 * np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) - len(hashes)
    fps = np.packbits(margin > 0).view(">u8").astype(np.uint64)
    own = margin.reshape(WIDE, 64)[:, : 64 // KEY_BITS * KEY_BITS].reshape(-1, KEY_BITS)
    unsure = np.argsort(np.abs(own), axis=1, kind="stable")[:, :FLIPS]
    keys = (((own > 0) @ _VALUES)[:, None] ^ _VALUES[unsure] @ _SUBSETS) << 4 | _SEGMENTS
    return fps, keys.ravel()


def _wide_prints(words: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(0).to_pylist()]
            made = [_wide_print(x) for x in sets]
            fps = np.array([m[0] for m in made], np.uint64).reshape(-1, WIDE).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            keys = pa.array([m[1] for m in made], pa.list_(pa.int64()))
            size = pa.array([len(x) for x in sets], pa.int64())
            arrays = [*(batch.column(c) for c in range(1, width)), *(pa.array(fps[:, i].copy()) for i in range(WIDE)), keys, pa.array(node), size]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[1:], *(f"f{i}" for i in range(WIDE)), "keys", "node", "size"])
    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _crowd_links(fps: np.ndarray) -> tuple[list, list]:
    """Links that join everything in a large bucket that some chain of linked pairs joins.

    Neighbours in the orders of the words are joined first. Then only pairs with a member outside the
    largest group so far can still join anything, so each of those members is compared with all others.
    """
    n = len(fps)
    left, right = [], []
    if n > ALL_PAIRS:
        for word in range(WIDE):
            order = np.argsort(fps[:, word], kind="stable")
            near = np.flatnonzero(_distance(fps[order[1:]], fps[order[:-1]]) <= WIDE_BUDGET)
            left.append(order[near])
            right.append(order[near + 1])
        root = local_roots(n, np.concatenate(left), np.concatenate(right))
        outside = np.flatnonzero(root != np.bincount(root).argmax())
    else:
        outside = np.arange(n)
    for i in outside:
        near = np.flatnonzero(_distance(fps, fps[i]) <= WIDE_BUDGET)
        left.append(np.full(len(near), i))
        right.append(near)
    return left, right


def wide_bucket_links(key: np.ndarray, node: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (as trees: member, root) between wide fingerprints of the same bucket. Sorted by key; whole buckets."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    length = np.repeat(size, size)
    place = np.arange(len(key)) - np.repeat(first, size)
    left, right = [], []
    for step in range(1, int(size[size <= PAIRWISE].max(initial=1))):
        a = np.flatnonzero((length <= PAIRWISE) & (place + step < length))
        a = a[np.bitwise_count(fps[a, 0] ^ fps[a + step, 0]) <= WIDE_BUDGET]
        a = a[_distance(fps[a], fps[a + step]) <= WIDE_BUDGET]
        left.append(a)
        right.append(a + step)
    for start, count in zip(first[size > PAIRWISE], size[size > PAIRWISE]):
        a, b = _crowd_links(fps[start : start + count])
        left += [x + start for x in a]
        right += [x + start for x in b]
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    nodes, at = np.unique(np.concatenate((node[left], node[right])), return_inverse=True)
    root = local_roots(len(nodes), at[: len(left)], at[len(left) :])
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[member], nodes[root[member]]


def _wide_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(key, node, *fps) -> pa.RecordBatch:
        links = wide_bucket_links(key, node, np.stack(fps, axis=1).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in links], ["u", "v"])

    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            columns = [np.concatenate(x) for x in zip(*held)]
            done = int(np.searchsorted(columns[0], columns[0][-1]))
            if done:
                yield emit(*(c[:done] for c in columns))
            held, rows = [[c[done:] for c in columns]], len(columns[0]) - done
    if rows:
        yield emit(*(np.concatenate(x) for x in zip(*held)))


# --- what fingerprints only suggest, held against the shingles themselves ---

#: A near copy shares ``LEAST`` of the shingles of both, as a fraction.
LEAST = (4, 5)
#: Members and shingles of a family in a block, and members that are compared with all blocks.
FAMILY_BLOCK, FAMILY_SHINGLES, SPOKESMEN = 512, 1 << 21, 16


def set_links(label: np.ndarray, sets: list[np.ndarray], asks: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) of similar sets that join what ``label`` keeps apart, until no asking set is similar to one apart from it."""
    ends = np.cumsum([len(x) for x in sets])
    size = np.diff(ends, prepend=0)
    root = np.unique(label, return_inverse=True)[1]
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    top, whole = LEAST
    out = []
    for i in np.flatnonzero(asks):
        apart = (root != root[i]) & (whole * np.minimum(size, size[i]) >= top * np.maximum(size, size[i]))
        if not apart.any():
            continue
        mine = np.zeros(len(values), bool)
        mine[code[ends[i] - size[i] : ends[i]]] = True
        met = np.concatenate(([0], np.cumsum(mine[code])))
        both = met[ends] - met[ends - size]
        similar = np.flatnonzero(apart & (whole * both >= top * (size + size[i] - both)))
        joined, at = np.unique(root[similar], return_index=True)
        out += [(int(i), int(j)) for j in similar[at]]
        root[np.isin(root, joined)] = root[i]
    return out


def _compare(group: pa.Table) -> pa.Table:
    node = group.column("node").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    pairs = np.array(set_links(group.column("label").to_numpy(), sets, group.column("asks").to_numpy(zero_copy_only=False)), np.int64).reshape(-1, 2)
    return pa.table([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["u", "v"])


def _blocks(n: Column, size: Column) -> Column:
    return F.ceil(F.greatest(n / FAMILY_BLOCK, size / FAMILY_SHINGLES, F.lit(1.0))).cast("int")


def _every(parts: Column) -> Column:
    return F.sequence(F.lit(0), parts - 1)


def verified(families: DataFrame, prints: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(u, v) links that join what chains of truly similar texts join, within each family (node, root) of candidates.

    A family is cut into blocks, each compared inside and with some members that go to all blocks, its spokesmen. Pairs
    that can still join anything have a member outside the family's largest group then; those are compared with all.
    ``prints`` has node, size and row of every text, ``texts`` row and t.
    """
    members = families.unionByName(families.select(F.col("root").alias("node"), "root")).distinct()
    one = lookup(prints.select("node", "row", "size"), members, ["node"], "row").groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("root").alias("family"))
    one = materialized(one, "family-members")
    cut = one.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("all"))
    cut = cut.select("family", "n", _blocks(F.col("n"), F.col("all")).alias("parts"))
    placed = lookup(one, cut, ["family"], "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([shingles(t, words).tobytes() for t in batch.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], [*batch.schema.names[1:], "shingles"])

    found = lookup(texts.select("t", "row"), placed, ["row"], "t").select("t", "node", "family", "size", "n", "parts").dropDuplicates(["node"])
    found = found.mapInArrow(in_slices(sets), "node long, family long, size long, n long, parts int, shingles binary")
    mark = F.xxhash64(F.lit(5), F.col("node"))
    part = F.pmod(F.xxhash64(F.lit(6), F.col("node")), F.col("parts")).cast("int")
    found = materialized(found.withColumn("part", part), "family-sets")
    speaks = F.pmod(mark, F.ceil(F.col("n") / SPOKESMEN)) == 0
    own = F.when(speaks, _every(F.col("parts"))).otherwise(F.array("part"))
    inside = found.select("node", "family", F.explode(own).alias("block"), "shingles", F.col("node").alias("label"), F.lit(True).alias("asks"))
    links = materialized(inside.groupBy("family", "block").applyInArrow(_compare, "u long, v long"), "family-links")
    large = found.filter("parts > 1")
    if large.isEmpty():
        return links
    groups = components(links)
    labelled = lookup(large, groups, ["node"], "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    most = labelled.groupBy("family", "label").agg(F.count("*").alias("held")).groupBy("family").agg(F.max_by("label", F.struct("held", "label")).alias("most"))
    labelled = lookup(labelled, most, ["family"], "node").withColumn("asks", F.col("label") != F.col("most"))
    outside = labelled.filter("asks").groupBy("family").agg(_blocks(F.count("*"), F.sum("size")).alias("turns"))
    labelled = materialized(lookup(labelled, outside, ["family"], "node"), "family-rest")
    turn = F.pmod(F.xxhash64(F.lit(7), F.col("node")), F.col("turns")).cast("int")
    told = labelled.withColumn("asks", F.lit(False)).withColumn("turn", F.explode(_every(F.col("turns")))).withColumn("block", F.col("part"))
    asked = labelled.filter("asks").withColumn("turn", turn).withColumn("block", F.explode(_every(F.col("parts"))))
    columns = ["family", "turn", "block", "node", "shingles", "label", "asks"]
    rest = told.select(columns).unionByName(asked.select(columns)).groupBy("family", "turn", "block").applyInArrow(_compare, "u long, v long")
    return links.unionByName(rest)


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, but of each group of near copies only the one with the smallest doc_id.

    Near copies are texts whose sets of shingles of ``words`` words have a Jaccard similarity of ``LEAST`` or more,
    directly or over others; those are compared whose wide fingerprints are linked (``WIDE_BUDGET``), directly or over
    others. Null ids come last, equal ids in the order of a hash of the row; of rows that agree in every column one
    stays. Texts without words are copies of each other. An empty table gives an empty one.
    """
    row = F.xxhash64(*[F.col(c) for c in docs.columns])
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    narrow = docs.select(F.col("text").alias("t"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("own"), row.alias("row"))
    fields = ", ".join(f"f{i} long" for i in range(WIDE))
    prints = narrow.mapInArrow(in_slices(_wide_prints(words, 4)), f"doc_id long, own string, row long, {fields}, keys array<long>, node long, size long")
    fps = [F.col(f"f{i}") for i in range(WIDE)]
    prints = materialized(prints, "wide-prints")
    distinct = prints.groupBy("node").agg(*[F.first(f"f{i}").alias(f"f{i}") for i in range(WIDE)], F.first("keys").alias("keys"))
    rows = distinct.select(F.explode("keys").alias("key"), "node", *fps)
    links = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_wide_link, "u long, v long")
    roots = components(verified(components(links), prints, narrow, words)).select(F.col("node").alias("linked"), "root")
    rooted = lookup(prints.select("doc_id", "own", "row", F.col("node").alias("linked")), roots, ["linked"], "row", "left")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "own", "row")
    stay = rooted.groupBy(F.coalesce("root", "linked").alias("root")).agg(F.min(order).alias("stay"))
    a, b = free_name(docs, "_own"), free_name(docs, "_row")
    chosen = stay.select(F.col("stay.own").alias(a), F.col("stay.row").alias(b))
    return docs.withColumns({a: own, b: row}).join(chosen, [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)
