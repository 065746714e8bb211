"""Fingerprints, links and groups against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from movewatch.llm import queries, simhash
from movewatch.llm.components import components, local_roots
from tests.llm.conftest import DOCS, prose


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(links, nodes):
    root = {n: n for n in nodes}
    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_components(rows):
    prints = {t: plain_print(t) for _, t in rows}
    values = sorted(set(prints.values()))
    root = plain_groups([(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2], values)
    least = {}
    for doc, text in rows:
        key = root[prints[text]]
        least[key] = min((x for x in (least.get(key), doc) if x is not None), default=None)
    return sorted(((d, f"{prints[t]:016x}", least[root[prints[t]]]) for d, t in rows), key=repr)


def test_groups_equal_plain(edge_docs):
    given = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = simhash.near_duplicates(edge_docs).collect()
    assert sorted(((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in got), key=repr) == plain_components(given)


def test_query_equals_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.QUERIES["op7_simhash_groups"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == plain_components(docs)


@pytest.mark.parametrize("crowd", [20, 150])  # below and above the size up to which a bucket is paired
def test_links_of_crowded_fingerprints(spark, crowd):
    rnd = random.Random(crowd)
    prints = []
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(crowd):
            p = centre
            for _ in range(rnd.randrange(4)):
                p ^= 1 << rnd.randrange(64)
            prints.append(p)
    values = sorted(set(prints))
    root = plain_groups([(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2], values)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in values]
    got = {r.fp % (1 << 64): r.root % (1 << 64) for r in simhash.groups(spark.createDataFrame(signed, "fp long")).collect()}
    assert len(set(root.values())) > 12
    by_mine, by_plain = {}, {}
    for v in values:
        by_mine.setdefault(got.get(v, v), set()).add(v)
        by_plain.setdefault(root[v], set()).add(v)
    assert sorted(map(sorted, by_mine.values())) == sorted(map(sorted, by_plain.values()))


def test_components(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 7)] + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(250)]
    nodes = sorted({n for link in links for n in link})
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == plain_groups(links, nodes)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert local_roots(5, np.array([4, 1]), np.array([2, 2])).tolist() == [0, 1, 1, 3, 1]


def similar(text, rnd, edits):
    words = text.split()
    for _ in range(edits):
        words[rnd.randrange(len(words))] = "changed"
    return " ".join(words)


def test_one_of_each_keeps_one_of_near_copies(spark):
    rnd = random.Random(9)
    rows, groups = [], {}
    for g in range(30):
        base = prose(500 + g, 250)
        for copy in range(1 + g % 4):
            rows.append((len(rows), similar(base, rnd, copy), "en", "s", 1))
            groups.setdefault(g, []).append(len(rows) - 1)
    rnd.shuffle(rows)
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {min(ids) for ids in groups.values()}


def test_large_group_of_near_copies(spark):
    rnd = random.Random(11)
    base, other = prose(600, 300), prose(601, 300)
    rows = [(i, similar(base, rnd, 2), "en", "s", 1) for i in range(300)] + [(1000, other, "en", "s", 1)]
    assert {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()} == {0, 1000}


def test_crowd_links_join_as_all_pairs_do(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, (6, 4)).astype(np.uint64)
    fps = centres[rng.integers(0, 6, 120)].copy()
    for row in fps:
        for bit in rng.integers(0, 256, rng.integers(0, 30)):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    whole = [np.concatenate(x) for x in simhash._crowd_links(fps)]
    monkeypatch.setattr(simhash, "ALL_PAIRS", 10)
    few = [np.concatenate(x) for x in simhash._crowd_links(fps)]
    assert np.array_equal(local_roots(120, *whole), local_roots(120, *few))


def test_one_of_each_of_edge_cases(edge_docs, no_docs):
    got = simhash.one_of_each(edge_docs)
    assert got.columns == edge_docs.columns
    rows = got.collect()
    texts = [r.text for r in rows if r.text and r.text.strip()]
    assert len(texts) == len(set(texts))
    assert [r.doc_id for r in rows if not (r.text or "").strip()] == [22]
    assert {1, 2, 3, 4, 5}.issubset({r.doc_id for r in rows})
    assert simhash.one_of_each(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0


def plain_kept(rows):
    """Smallest ids of the groups that pairs of five-word Jaccard 0.8 make, all pairs compared."""
    sets = {}
    for doc, text in rows:
        w = text.encode().lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    links = [(a, b) for a, s in sets.items() for b, t in sets.items() if a < b and 5 * len(s & t) >= 4 * len(s | t)]
    return set(plain_groups(links, list(sets)).values())


def test_repeated_line_makes_no_near_copies(spark):
    line = prose(700, 12)
    rows = [(i, prose(710 + i, 200) + " " + " ".join([line] * 40)) for i in range(12)]
    rows += [(100 + i, prose(710 + i, 200) + " " + " ".join([line] * 38)) for i in range(12)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    assert plain_kept(rows) == set(range(12))
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == plain_kept(rows)


@pytest.mark.parametrize("block", [512, 7])  # families whole and in blocks
def test_chains_and_crowds_equal_plain(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "FAMILY_BLOCK", block)
    monkeypatch.setattr(simhash, "SPOKESMEN", 2)
    rnd = random.Random(17)
    rows = []
    for g in range(4):  # crowds about one text, some of whose members are less than 0.8 alike
        base = prose(800 + g, 250)
        rows += [(len(rows) + i, similar(base, rnd, rnd.randrange(1, 9))) for i in range(30)]
    text = prose(820, 250)  # each like the one before it only
    for _ in range(20):
        text = similar(text, rnd, 4)
        rows.append((len(rows), text))
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == plain_kept(rows)
