import random

import pytest
from pyspark.sql import functions as F

from conftest import DAY, by_key, plan_of, rows_of
from movewatch import schemas
from movewatch.operators import graph, retrieval
from movewatch.operators.anomaly import scan_watchlist
from movewatch.operators.bars import anchors, price_bounds
from movewatch.sources import tables


def test_peers(companies, spark):
    asked = spark.createDataFrame([("BB1",), ("CCC",), ("NOS1",), ("GONE",)], "company_id string")
    assert rows_of(retrieval.peers(companies, asked), "company_id", "peer_id") == [("BB1", "BB2"), ("BB1", "BB3")]
    safe = rows_of(retrieval.peers(companies, asked, null_safe=True), "company_id", "peer_id")
    assert safe == [("BB1", "BB2"), ("BB1", "BB3"), ("NOS1", "NOS2")]


def test_peer_groups(companies):
    plain = by_key(retrieval.peer_groups(companies), "company_id")
    assert (plain["BB1"]["n_peers"], plain["CCC"]["n_peers"], plain["NOS1"]["n_peers"]) == (2, 0, 0)
    assert by_key(retrieval.peer_groups(companies, null_safe=True), "company_id")["NOS1"]["n_peers"] == 1


def test_ordered_peers_number_a_large_sector(spark):
    rows = [(f"c{i}", f"n{i}", "S") for i in range(700)]
    companies = spark.createDataFrame(rows, schemas.COMPANY)
    asked = spark.createDataFrame([("c0",), ("c5",)], "company_id string")
    got = retrieval.ordered_peers(companies, asked)
    for company in ("c0", "c5"):
        places = sorted(r["position"] for r in got.filter(F.col("company_id") == company).collect())
        assert places == list(range(699))


def test_news_window_has_only_a_lower_bound(news, bars):
    week = retrieval.news_window(news, anchors(bars), 7)
    assert rows_of(week, "id") == [("n1",), ("n3",)]  # n3 is after the anchor, the stale n2 is out
    assert rows_of(retrieval.news_window(news, anchors(bars), 14), "id") == [("n1",), ("n2",), ("n3",)]
    ordered = [r["id"] for r in retrieval.newest_first(week).collect()]
    assert ordered == ["n3", "n1"]


def test_discussion_window_names_the_body(discussion, bars):
    got = retrieval.discussion_window(discussion, anchors(bars))
    assert got.columns == ["company_id", "id", "body", "source", "published_at"] and got.count() == 6


def test_latest_signals_null_time_last(spark):
    rows = [(f"i{i:02}", "A", "h", None, None, None, None if i == 0 else i) for i in range(12)]
    got = retrieval.latest_signals(spark.createDataFrame(rows, schemas.NEWS), k=12)
    ranks = by_key(got, "id")
    assert ranks["i11"]["rank"] == 1 and ranks["i00"]["rank"] == 12 and ranks["i00"]["summary"] == ""
    assert retrieval.latest_signals(spark.createDataFrame(rows, schemas.NEWS)).count() == 10


def test_event_markers_bounds_are_inclusive(spark, bars):
    b = by_key(price_bounds(bars), "company_id")["CCC"]
    times = {"in1": b["from_ms"], "in2": b["to_ms"], "out1": b["from_ms"] - 1, "out2": b["to_ms"] + 1}
    news = spark.createDataFrame([(i, "CCC", "h", None, None, None, t) for i, t in times.items()], schemas.NEWS)
    posts = spark.createDataFrame([("p", "CCC", "t", "", None, None, b["to_ms"]), ("q", "NOBARS", "t", "", None, None, 1)], schemas.DISCUSSION)
    got = retrieval.event_markers(news, posts, price_bounds(bars)).orderBy("time", "type_rank", "signal_id").collect()
    assert [r["signal_id"] for r in got] == ["in1", "in2", "p"]
    assert got[0]["time"] == b["from_ms"] // 1000


def _markers(spark, rows):
    return spark.createDataFrame(rows, "company_id string, time long, signal_id string, type string, type_rank int")


def test_nearest_marker_edges(spark):
    markers = _markers(spark, [("A", 1_000_000, "m", "news", 0), ("B", 1000, "first", "discussion", 1), ("B", 3000, "second", "news", 0),
                               ("C", 50, "post", "discussion", 1), ("C", 50, "item", "news", 0)])
    points = spark.createDataFrame([("A", 1_172_799), ("A", 1_172_800), ("A", 827_201), ("A", 827_200), ("B", 2000), ("C", 60), ("C", 60)], "company_id string, time long")
    got = rows_of(retrieval.nearest_signal(points, markers), "company_id", "time", "signal_id", "distance_s")
    assert set(got) == {("A", 827_201, "m", 172_799), ("A", 1_172_799, "m", 172_799), ("B", 2000, "first", 1000), ("C", 60, "item", 10)}
    assert len(got) == 4


@pytest.mark.parametrize("tol", [7, 60, 1000])
def test_nearest_marker_matches_brute_force(spark, tol):
    rng = random.Random(tol)
    points = [(rng.choice("AAAB"), rng.randint(-500, 5000)) for _ in range(800)]
    markers = [(rng.choice("AAAC"), rng.randint(-500, 5000), f"s{i}", *rng.choice([("news", 0), ("discussion", 1)])) for i in range(300)]
    df = retrieval.nearest_signal(spark.createDataFrame(points, "company_id string, time long"), _markers(spark, markers), tol)
    got = {(r["company_id"], r["time"]): (r["signal_id"], r["distance_s"]) for r in df.collect()}
    want = {}
    for c, t in set(points):
        near = sorted((abs(m[1] - t), m[1], m[4], m[2]) for m in markers if m[0] == c and abs(m[1] - t) < tol)
        if near:
            want[c, t] = (near[0][3], near[0][0])
    assert got == want


def test_nearest_marker_forms_no_pairs(spark):
    markers = _markers(spark, [("A", 1, "m", "news", 0)])
    plan = plan_of(retrieval.nearest_signal(spark.createDataFrame([("A", 2)], "company_id string, time long"), markers))
    assert "Join" not in plan


def test_watchlist_keeps_the_first_occurrence(spark):
    real = spark.createDataFrame([("AAPL", 0), ("MSFT", 1)], "company_id string, ordinal int")
    demo = spark.createDataFrame([("NMBS", 0), ("AAPL", 1)], "company_id string, ordinal int")
    got = retrieval.watchlist(real, demo).orderBy("list_no", "ordinal").collect()
    assert [r["company_id"] for r in got] == ["AAPL", "MSFT", "NMBS"]
    lists = tables.named_companies(spark), tables.named_companies(spark, schemas.DEMO_COMPANIES)
    got = retrieval.watchlist(*lists).orderBy("list_no", "ordinal").collect()
    assert [r["company_id"] for r in got] == ["AAPL", "MSFT", "GOOGL", "AMZN", "NVDA", "NMBS", "ORCH", "HLIX", "VRTA", "DRFT"]


def test_known_companies(companies, spark):
    asked = spark.createDataFrame([("aaa",), ("AAA",), ("nope",)], "ticker string")
    assert rows_of(retrieval.known_companies(asked, companies), "company_id", "known") == [("AAA", True), ("NOPE", False)]


def test_scan_summary(companies, bars, news):
    got = retrieval.scan_summary(companies, scan_watchlist(bars), news).first().asDict()
    assert got == {"scanned": 12, "flagged": 6, "findings": 3}


# --- graph ------------------------------------------------------------------


@pytest.fixture(scope="module")
def nodes(companies, news, discussion, spark):
    focus = spark.createDataFrame([("BB1",), ("VOL",)], "company_id string")
    return graph.graph_nodes(companies, news, discussion, focus).persist()


def test_graph_nodes(nodes):
    got = by_key(nodes, "node_id")
    assert got["AAA-news-n3"]["ordinal"] == 0 and got["AAA-news-n1"]["ordinal"] == 1
    assert got["VOL-related-QUI"]["ordinal"] == 6  # after six posts
    assert got["VOL-related-QUI"]["delay_s"] == pytest.approx(0.3)
    assert {got["BB1-related-BB2"]["ordinal"], got["BB1-related-BB3"]["ordinal"]} == {1, 2}
    assert got["AAA"]["node_type"] == "company" and got["AAA"]["parent_id"] is None


def test_graph_edges_and_focus(nodes, spark):
    edges = graph.graph_edges(nodes)
    assert ("edge-AAA-AAA-news-n1", "AAA", "AAA-news-n1") in rows_of(edges, "edge_id", "src", "dst")
    assert graph.valid_edges(edges, nodes).count() == edges.count()
    gone = nodes.filter(F.col("node_id") != "AAA")
    assert graph.valid_edges(edges, gone).filter(F.col("src") == "AAA").count() == 0
    dim = by_key(graph.focus_nodes(nodes, "AAA"), "node_id")
    assert not dim["AAA"]["dimmed"] and not dim["AAA-news-n1"]["dimmed"] and dim["BB1"]["dimmed"]
    assert graph.focus_nodes(nodes).filter("dimmed").count() == 0
    lit = graph.focus_edges(edges, "AAA-news-n1").filter("highlighted").collect()
    assert [r["dst"] for r in lit] == ["AAA-news-n1"]


def test_node_diff(spark):
    old = spark.createDataFrame([("a",), ("b",)], "node_id string")
    new = spark.createDataFrame([("b",), ("c",), ("c",)], "node_id string")
    assert rows_of(graph.node_diff(old, new), "node_id", "change") == [("a", "removed"), ("c", "added")]
