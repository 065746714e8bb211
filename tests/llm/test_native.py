"""Mixing, URL rules and shards against plain Python and SQL."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from movewatch.llm import mixing, queries, sharding, url_filter
from movewatch.llm.common import word_count
from pyspark.sql import functions as F
from tests.conftest import plan_of

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not DATA.exists(), reason="given tables are not here")
@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


# --- mixing ---

def plain_targets(totals, weights, most):
    """Water-filling by bisection of the level."""
    order = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None] * (None in totals)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    words = sum(totals.values())
    low, high = 0.0, 1e18
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * totals[s], level * weight[s]) for s in totals) < words else (low, level)
    return {s: min(most * totals[s], low * weight[s]) if totals[s] else 0.0 for s in totals}


def test_mix(edge_docs):
    words = "n_words"
    sized = edge_docs.withColumn(words, word_count(F.col("text")))
    rows = mixing.mix(sized, F.col(words), (5, 2, 1), 3.0, identity=[F.col("doc_id"), F.md5("text")]).collect()
    assert len(rows) == edge_docs.count()
    totals, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r.size
        totals[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    expected = plain_targets(totals, (5, 2, 1), 3.0)
    assert {s: round(t, 4) for s, t in target.items()} == {s: round(t, 4) for s, t in expected.items()}
    assert all(r.source_size == totals[r.source] for r in rows)
    # rows that repeat each other share what they get, rounded down
    assert all(abs(taken[s] - target[s]) <= 3 for s in totals)


def test_mix_reruns_agree_whatever_the_partitions(edge_docs):
    def run(n):
        sized = edge_docs.repartition(n).withColumn("n_words", word_count(F.col("text")))
        mixed = mixing.mix(sized, F.col("n_words"), (5, 2, 1), identity=[F.col("doc_id"), F.md5("text")])
        return sorted(((r.doc_id, r.size, r.taken) for r in mixed.collect()), key=repr)
    assert run(1) == run(7)


def test_repeated_takes_whole_copies(spark):
    rows = [(1, 10, 30), (2, 10, 14), (3, 10, 15), (4, 10, 0), (5, 0, 0)]
    df = spark.createDataFrame([(*r, 1, 1.0) for r in rows], "doc_id long, size long, taken long, source_size long, target double")
    assert Counter(r.doc_id for r in mixing.repeated(df).collect()) == {1: 3, 2: 1, 3: 2}


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs, word_count(F.col("text")), (5, 2, 1), identity=[F.col("doc_id")]).count() == 0


# --- URL rules ---

URLS = [
    None, "", "no scheme", "http://", "http:///en/", "HTTP://Example.ORG/en/1x?q=1#f", "http://example.org", "http://a.b.example.org/es/",
    "http://notexample.org/es/", "http://example.org/en/2", "ftp://x.com/de/a", "http://com/fr/", "http://x.com/fr", "http://x.com.evil/de/",
    "a://b://org/", "http://ORG/", "http://é.org/É", "http://x.org:80/", "http://.org/", "http://x.org?/es/", "http://" + "a." * 40 + "example.org/es/" + "z" * 5000,
    "http://x.com/de/a", "http://x.com/de/a",
]


def plain_judge(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.action if best else "allow"


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, rule string, _keys string")
    judged = url_filter.judge(pages, queries.URL_RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert got == {i: plain_judge(u, queries.URL_RULES) for i, u in enumerate(URLS)}
    plan = plan_of(judged)
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"host{i}.org/p{i % 7}" for i in range(6000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string").repartition(4)
    for listed in (keys[::9], keys[:1], [], keys):
        cascade = url_filter.Cascade.of(listed, universe, "key")
        got = {r.key for r in universe.filter(cascade.holds(F.col("key"))).collect()}
        assert got == set(listed)


def test_cascade_with_a_weak_first_level(spark):
    keys = [f"k{i}" for i in range(400)]
    listed = keys[::2]
    first = url_filter.Level.of(listed, 0, 0.4)
    strays = [k for k in keys if first.knows(k) and k not in set(listed)]
    cascade = url_filter.Cascade(url_filter.deepened(listed, strays, first))
    assert len(cascade.levels) > 2
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert {r.key for r in df.filter(cascade.holds(F.col("key"))).collect()} == set(listed)


def test_no_pages_and_many_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, queries.URL_RULES).count() == 0
    many = [url_filter.Rule("block", f"h{i}.net", "/") for i in range(300)] + [url_filter.Rule("allow", "h7.net", "/ok")]
    pages = spark.createDataFrame([(i, f"http://www.h{i}.net/{p}") for i in range(0, 400, 3) for p in ("ok", "no")], "page_id long, url string")
    got = sorted((r.url, r.rule, r.verdict) for r in url_filter.judge(pages, many).collect() if r.rule)
    want = sorted((r.url, *plain_judge(r.url, many)[2:]) for r in pages.collect() if plain_judge(r.url, many)[2])
    assert got == want


# --- shards ---

def plain_walk(positions, nodes, capacity, bits):
    """Every row on its own, round by round: shards' row counts and each row's shard."""
    order = sorted(range(len(positions)), key=lambda i: positions[i])
    waiting = defaultdict(list)
    for i in order:
        cell = positions[i] >> (63 - bits)
        waiting[next((n for n, (c, _) in enumerate(nodes) if c >= cell), 0)].append(i)
    room, shard = list(capacity), {}
    while any(waiting.values()):
        moved = defaultdict(list)
        for n, (_, s) in enumerate(nodes):
            # rows of later cells wait behind those of earlier ones
            for i in waiting[n]:
                if room[s]:
                    room[s] -= 1
                    shard[i] = s
                else:
                    moved[(n + 1) % len(nodes)].append(i)
        waiting = moved
    return shard


def test_shards(edge_docs):
    docs = edge_docs.withColumn("n", F.length("text"))
    got = sharding.assign(docs, 8, ("doc_id", "n")).collect()
    assert len(got) == edge_docs.count() and set(edge_docs.columns) <= set(got[0].asDict())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_equal_a_walk_of_single_rows(spark):
    df = spark.createDataFrame([(i, 0) for i in range(700)], "doc_id long, n long")
    at = {r.doc_id: r.p for r in df.select("doc_id", sharding.position(("doc_id", "n")).alias("p")).collect()}
    got = {r.doc_id: r.shard for r in sharding.assign(df, 5, ("doc_id", "n"), points=6).collect()}
    nodes = sharding.ring(5, 6)
    assert got == plain_walk([at[i] for i in range(700)], nodes, sharding.equal_shares(700, 5), sharding.CELL_BITS)


def test_rows_overflow_clockwise_and_little_moves(spark):
    counts = {c: 1 for c in range(0, 1 << 16, 16)}
    rows = len(counts)
    def home(shards, slack):
        nodes = sharding.ring(shards)
        capacity = [round(slack * c) + 1 for c in sharding.equal_shares(rows, shards)]
        return {r.cell: r.shard for r in sharding.walk(counts, nodes, capacity)}
    free, bounded = home(8, 8), home(8, 1)
    assert max(Counter(bounded.values()).values()) <= rows // 8 + 2
    assert sum(free[c] != bounded[c] for c in counts) < 0.3 * rows
    grown = home(9, 8)
    assert all(grown[c] in (free[c], 8) for c in counts)  # without bounds, only the new shard gains


def test_no_rows(no_docs):
    assert sharding.assign(no_docs, 8).count() == 0


def test_one_id_with_a_third_of_the_rows_lies_all_around_the_ring(spark):
    rows = [(7 if i % 3 == 0 else i, i) for i in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, n long").repartition(8)
    cell = F.shiftright(sharding.position(("doc_id", "n")), 63 - sharding.CELL_BITS)
    assert df.groupBy(cell).count().agg(F.max("count")).first()[0] < 12
    got = sharding.assign(df, 8, ("doc_id", "n")).groupBy("shard").agg(F.count("*").alias("rows"), F.max("slot").alias("top"), F.countDistinct("slot").alias("slots")).collect()
    assert all(r.rows == 3750 == r.slots and r.top == 3749 for r in got) and len(got) == 8


def test_native_plans_have_no_python(spark):
    for name in ("op5_url_filter", "op9_shards"):
        plan = plan_of(queries.QUERIES[name](spark, str(DATA)))
        assert not re.search("Python|Pandas|Arrow", plan)
