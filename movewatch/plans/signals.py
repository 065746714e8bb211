"""Queries over companies, news, discussion, feeds and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movewatch.functions import scalar
from movewatch.operators import attribution, bars, graph, quality, retrieval
from movewatch.operators.anomaly import score_watchlist
from movewatch.operators.ordered import top_n
from movewatch.plans.bindings import AS_OF_MS, NEWS_LEAST, Market
from movewatch.plans.catalog import VIEWS, _poll, query
from movewatch.plans.market import lead_movers
from movewatch.session import fresh_dir
from movewatch.sources import feeds, sinks

# --- sources and sinks ------------------------------------------------------


@query("src1_companies", "SELECT company_id, name, sector FROM company")
def companies(m: Market) -> DataFrame:
    return m.companies


@query("src2_ingest_bars", """
SELECT company_id, CASE WHEN event_id % 89 <> 1 THEN ms END AS ts_ms, round(value, 6) AS open, round(value, 6) AS high,
  round(value, 6) AS low, round(value, 6) AS close, CASE WHEN event_id % 23 <> 2 THEN cast(k AS bigint) END AS volume,
  CASE WHEN event_id % 89 = 1 THEN 'bad_ts' WHEN event_id % 23 = 2 THEN 'bad_volume'
    WHEN ms > first_bad THEN 'after_bad' END AS reason
FROM (SELECT *, min(ms) FILTER (event_id % 23 = 2 AND event_id % 89 <> 1) OVER (PARTITION BY company_id, ms // 86400000) AS first_bad FROM ev)""")
def ingest_bars(m: Market) -> DataFrame:
    return feeds.ingest_bars(m.bar_feed, poll=["poll_day"])


_FEED = """
SELECT *, min(rn) FILTER (bad) OVER (PARTITION BY company_id, poll) AS first_bad
FROM (SELECT *, n AS rn, {bad} AS bad FROM ({poll}) WHERE n <= 5)"""
_NEWS_FEED = _FEED.format(bad="event_id % 7 <> 3 AND event_id % 11 = 5", poll=_poll("error"))
_POST_FEED = _FEED.format(bad="event_id % 11 = 5", poll=_poll("click"))
NEWS_ROWS = f"""
SELECT cast(event_id // 2 AS varchar) AS id, company_id, 'Item ' || k AS headline, '' AS summary, 'wire' AS source,
  CASE WHEN event_id % 7 <> 3 THEN 'https://example.org/' || (event_id // 2) ELSE '' END AS url,
  CASE WHEN event_id % 11 <> 5 THEN ms END AS published_at, cast(rn - 1 AS int) AS pos,
  CASE WHEN rn > coalesce(first_bad, 99) THEN 'after_bad' WHEN event_id % 7 = 3 THEN 'no_url' WHEN bad THEN 'bad_date' END AS reason
FROM ({_NEWS_FEED})"""


@query("src3_ingest_news", NEWS_ROWS)
def ingest_news(m: Market) -> DataFrame:
    return feeds.ingest_news(m.news_polls)


POST_ROWS = f"""
SELECT cast(event_id AS varchar) AS id, company_id, 'Post ' || k AS title, '' AS summary, 'Stocktwits' AS source,
  'https://stocktwits.com/message/' || event_id AS url, CASE WHEN NOT bad THEN ms END AS published_at,
  cast(rn - 1 AS int) AS pos, CASE WHEN rn > coalesce(first_bad, 99) THEN 'after_bad' WHEN bad THEN 'bad_date' END AS reason
FROM ({_POST_FEED})"""


@query("src4_ingest_discussion", POST_ROWS)
def ingest_discussion(m: Market) -> DataFrame:
    return feeds.ingest_discussion(m.discussion_polls)


@query("sink1_append_news", f"""
SELECT * EXCLUDE (reason, rank) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY company_id, published_at, pos) AS rank FROM ({NEWS_ROWS}) WHERE reason IS NULL)
WHERE rank = 1 AND id NOT IN (SELECT id FROM news)""")
def append_news(m: Market) -> DataFrame:
    """New articles by id; the same id under two companies is kept for the first."""
    new = feeds.accepted(feeds.ingest_news(m.news_polls))
    order = [F.asc("company_id"), F.asc("published_at"), F.asc("pos")]
    return sinks.append_new(new, m.news, sinks.ITEM_KEYS, order, sinks.REQUIRED["news"])


@query("sink1_append_bars", """
SELECT company_id, ts_ms, round(close, 6) AS close, volume FROM (
  SELECT company_id, (ms // 1800000) * 1800000 AS ts_ms, arg_min(value, event_id) AS close, arg_min(cast(k AS bigint), event_id) AS volume
  FROM ev GROUP BY ALL) h
WHERE NOT EXISTS (SELECT 1 FROM bar b WHERE b.company_id = h.company_id AND b.ts_ms = h.ts_ms)""")
def append_bars(m: Market) -> DataFrame:
    """Half-hour rows appended to the hourly bars: the first event of a key wins."""
    half = (F.floor(F.col("ms") / F.lit(1_800_000)) * F.lit(1_800_000)).cast("long")
    new = m.events.select(
        "company_id", half.alias("ts_ms"), F.col("value").alias("close"), F.col("k").cast("long").alias("volume"), "event_id"
    )
    return sinks.append_new(new, m.bars, sinks.BAR_KEYS, [F.asc("event_id")]).drop("event_id")


@query("sink2_seed_missing", """
SELECT cast(c_custkey AS varchar) AS company_id, c_name AS name, c_mktsegment AS sector FROM customer
WHERE cast(c_custkey AS varchar) NOT IN (SELECT company_id FROM company)""")
def seed_missing(m: Market) -> DataFrame:
    """Customers that are not companies yet."""
    listed = m.table("customer").select(
        F.col("c_custkey").cast("string").alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector")
    )
    return sinks.seed_missing(listed, m.companies)


@query("sink3_replace_scope", """
SELECT company_id, ts_ms, round(close, 6) AS close, volume FROM bar WHERE company_id NOT IN (SELECT company_id FROM lead)
UNION ALL SELECT company_id, ts_ms, round(close, 6), volume FROM tick WHERE company_id IN (SELECT company_id FROM lead)""")
def replace_scope(m: Market) -> DataFrame:
    """The hourly bars of the lead movers replaced by their ticks."""
    scope = lead_movers(m)
    new = m.ticks.join(scope, "company_id", "left_semi")
    return sinks.replace_scope(new, m.bars, scope).select("company_id", "ts_ms", "close", "volume")


@query("dq1_check_constraints", """
SELECT 'bar' AS "table", 'unique' AS rule, 'company_id,ts_ms' AS "column", company_id || '|' || ts_ms AS key, count(*) AS n
FROM (SELECT company_id, (ms // 600000) * 600000 AS ts_ms FROM ev) GROUP BY company_id, ts_ms HAVING count(*) > 1
UNION ALL SELECT 'bar', 'foreign_key', 'company_id', company_id, count(*) FROM ev WHERE company_id IN (SELECT company_id FROM gappy WHERE sector IS NULL) GROUP BY company_id
UNION ALL SELECT 'news', 'not_null', 'headline', NULL, count(*) FROM (SELECT 1 FROM news WHERE summary IS NULL) HAVING count(*) > 0
UNION ALL SELECT 'news', 'foreign_key', 'company_id', company_id, count(*) FROM news WHERE company_id IN (SELECT company_id FROM gappy WHERE sector IS NULL) GROUP BY company_id""")
def check_constraints(m: Market) -> DataFrame:
    """Ten-minute bars with repeated keys, news without headline, companies left out."""
    slot = (F.floor(F.col("ms") / F.lit(600_000)) * F.lit(600_000)).cast("long")
    return quality.check_constraints({
        "company": m.gappy_companies.filter(F.col("sector").isNotNull()),
        "bar": m.events.select("company_id", slot.alias("ts_ms")),
        "news": m.news.withColumn("headline", F.col("summary")),
    })


# --- scalar functions -------------------------------------------------------


@query("sc1_iso_to_ms", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(try_cast(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS timestamp)) // 1000
  WHEN 1 THEN epoch_us(try_cast(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+05:30' AS timestamptz)) // 1000 END AS ms FROM ev""")
def iso_to_ms(m: Market) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 4
    iso = (
        F.when(kind == 0, F.concat(text, F.lit("Z")))
        .when(kind == 1, F.concat(text, F.lit("+05:30")))
        .when(kind == 2, F.concat(F.lit("2024-13-01T00:00:0"), F.col("k").cast("string")))
        .otherwise("yesterday")
    )
    return m.events.select("event_id", scalar.iso_to_ms(iso).alias("ms"))


@query("sc2_ms_to_s", "SELECT event_id, ms // 1000 AS s, (ms // 1000) * 1000 AS back_ms FROM ev")
def ms_to_s(m: Market) -> DataFrame:
    s = scalar.ms_to_s("ms")
    return m.events.select("event_id", s.alias("s"), scalar.ts_to_ms(scalar.ms_to_ts(s * 1000)).alias("back_ms"))


@query("sc3_market_hours", """
SELECT event_id, dayofweek(l) BETWEEN 1 AND 5 AND cast(l AS time) BETWEEN TIME '09:30:00' AND TIME '16:00:00' AS open
FROM (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS l FROM ev)""")
def market_hours(m: Market) -> DataFrame:
    return m.events.select("event_id", scalar.is_market_hours("ts").alias("open"))


@query("sc4_norm_ticker", "SELECT DISTINCT upper(c_name) AS ticker FROM customer")
def norm_ticker(m: Market) -> DataFrame:
    return m.table("customer").select(scalar.norm_ticker("c_name").alias("ticker")).distinct()


@query("sc5_blank_nulls", "SELECT id, headline, coalesce(summary, '') AS summary, source, coalesce(url, '') AS url FROM news")
def blank_nulls(m: Market) -> DataFrame:
    return scalar.blank_nulls(m.news).select("id", "headline", "summary", "source", "url")


@query("sc6_recency_size", f"""
SELECT id, cast(floor(greatest(8, least(20, 20 - ({AS_OF_MS} - published_at) / 3600000.0 * (12.0 / 72.0))) + 0.5) AS bigint) AS size FROM news""")
def recency_size(m: Market) -> DataFrame:
    return m.news.select("id", scalar.recency_size("published_at", AS_OF_MS).alias("size"))


@query("sc7_age_label", f"""
SELECT id, CASE WHEN mi < 60 THEN mi || 'm ago' WHEN mi // 60 < 24 THEN (mi // 60) || 'h ago' ELSE (mi // 1440) || 'd ago' END AS age
FROM (SELECT id, ({AS_OF_MS} - published_at) // 60000 AS mi FROM discussion)""")
def age_label(m: Market) -> DataFrame:
    return m.discussion.select("id", scalar.age_label("published_at", AS_OF_MS).alias("age"))


@query("sc8_pct_label", """
SELECT company_id, CASE WHEN latest_return >= 0 THEN '+' ELSE '' END || printf('%.2f', latest_return * 100) || '%' AS label FROM score""")
def pct_label(m: Market) -> DataFrame:
    return score_watchlist(m.bars).select("company_id", scalar.pct_label(F.col("latest_return") * 100).alias("label"))


@query("sc9_price_label", "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS label FROM orders")
def price_label(m: Market) -> DataFrame:
    return m.table("orders").select("o_orderkey", scalar.price_label("o_totalprice").alias("label"))


@query("sc13_api_prices", """
SELECT company_id AS "companyId", ts_ms AS "timestamp", round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
  round(close, 6) AS close, volume FROM bar""")
def api_prices(m: Market) -> DataFrame:
    return scalar.to_api(m.bars)


@query("sc13_api_signals", """
SELECT id, company_id AS "companyId", headline, coalesce(summary, '') AS summary, source, coalesce(url, '') AS url, published_at AS "publishedAt" FROM news""")
def api_signals(m: Market) -> DataFrame:
    return scalar.to_api(scalar.blank_nulls(m.news))


@query("sc15_known_companies", """
SELECT upper(cast(c_custkey AS varchar)) AS company_id, c_custkey IN (SELECT user_id FROM events) AS known FROM customer""")
def known_companies(m: Market) -> DataFrame:
    asked = m.table("customer").select(F.col("c_custkey").cast("string").alias("ticker"))
    return retrieval.known_companies(asked, m.companies)


# --- joins and top-k --------------------------------------------------------


@query("jn1_peer_groups", """
SELECT company_id, name, sector, CASE WHEN sector IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY sector) - 1 END AS n_peers FROM gappy""")
def peer_groups(m: Market) -> DataFrame:
    return retrieval.peer_groups(m.gappy_companies)


@query("jn1_peers_of_lead_movers", """
SELECT a.company_id, b.company_id AS peer_id, b.name AS peer_name, b.sector
FROM gappy a JOIN gappy b ON a.sector = b.sector AND a.company_id <> b.company_id WHERE a.company_id IN (SELECT company_id FROM lead)""")
def peers_of_lead_movers(m: Market) -> DataFrame:
    return retrieval.peers(m.gappy_companies, lead_movers(m))


@query("jn2_peer_groups_null_safe", "SELECT company_id, name, sector, count(*) OVER (PARTITION BY sector) - 1 AS n_peers FROM gappy")
def peer_groups_null_safe(m: Market) -> DataFrame:
    return retrieval.peer_groups(m.gappy_companies, null_safe=True)


@query("jn2_peers_null_safe", """
SELECT a.company_id, b.company_id AS peer_id, b.name AS peer_name, b.sector
FROM gappy a JOIN gappy b ON a.sector IS NOT DISTINCT FROM b.sector AND a.company_id <> b.company_id WHERE a.company_id IN (SELECT company_id FROM lead)""")
def peers_null_safe(m: Market) -> DataFrame:
    return retrieval.peers(m.gappy_companies, lead_movers(m), null_safe=True)


@query("jn3_news_window", """
SELECT n.company_id, id, headline, summary, source, published_at FROM news n JOIN anchor a USING (company_id)
WHERE published_at >= anchor_ms - 7 * 86400000""")
def news_window(m: Market) -> DataFrame:
    return retrieval.news_window(m.news, bars.anchors(m.bars))


@query("jn4_discussion_window", """
SELECT d.company_id, id, title AS body, source, published_at FROM discussion d JOIN anchor a USING (company_id)
WHERE published_at >= anchor_ms - 7 * 86400000""")
def discussion_window(m: Market) -> DataFrame:
    return retrieval.discussion_window(m.discussion, bars.anchors(m.bars))


@query("jn5_event_markers", "SELECT company_id, time, signal_id, type, cast(type_rank AS int) AS type_rank FROM marker")
def event_markers(m: Market) -> DataFrame:
    return retrieval.event_markers(m.news, m.discussion, bars.price_bounds(m.bars))


_NEAREST = """
SELECT company_id, time, signal_id, type, marker_time, distance_s FROM (
  SELECT p.company_id, p.time, m.signal_id, m.type, m.time AS marker_time, abs(m.time - p.time) AS distance_s,
    row_number() OVER (PARTITION BY p.company_id, p.time ORDER BY abs(m.time - p.time), m.time, m.type_rank, m.signal_id) AS rn
  FROM (SELECT DISTINCT company_id, ts_ms // 1000 AS time FROM bar) p JOIN marker m USING (company_id)
  WHERE abs(m.time - p.time) < {tol}) WHERE rn = 1"""


@query("jn6_nearest_signal", _NEAREST.format(tol=172800))
def nearest_signal(m: Market) -> DataFrame:
    points = m.bars.select("company_id", scalar.ms_to_s("ts_ms").alias("time"))
    return retrieval.nearest_signal(points, event_markers(m))


@query("jn6_nearest_signal_hour", _NEAREST.format(tol=3600))
def nearest_signal_hour(m: Market) -> DataFrame:
    points = m.bars.select("company_id", scalar.ms_to_s("ts_ms").alias("time"))
    return retrieval.nearest_signal(points, event_markers(m), tol_s=3600)


@query("tk1_latest_news", """
SELECT company_id, id, headline, coalesce(summary, '') AS summary, source, coalesce(url, '') AS url, published_at, cast(rn AS int) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC NULLS LAST, id) AS rn FROM news) WHERE rn <= 10""")
def latest_news(m: Market) -> DataFrame:
    return retrieval.latest_signals(m.news)


@query("tk1_latest_discussion", """
SELECT company_id, id, title, coalesce(summary, '') AS summary, source, coalesce(url, '') AS url, published_at, cast(rn AS int) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC NULLS LAST, id) AS rn FROM discussion) WHERE rn <= 10""")
def latest_discussion(m: Market) -> DataFrame:
    return retrieval.latest_signals(m.discussion)


@query("st2_unified_signals", """
SELECT 'news' AS type, id, headline, summary, source, url, company_id, published_at FROM news
UNION ALL SELECT 'discussion', id, title, summary, source, url, company_id, published_at FROM discussion""")
def unified_signals(m: Market) -> DataFrame:
    return retrieval.unified_signals(m.news, m.discussion)


# --- attribution ------------------------------------------------------------

ATTRIBUTION = attribution.AttributionParams(min_news=NEWS_LEAST)


def _attributed(m: Market) -> DataFrame:
    flagged = score_watchlist(m.bars, z=0.3).filter("flagged")
    return attribution.attribute(flagged, m.news, m.discussion, m.companies, ATTRIBUTION)


@query("at1_attribute", """
SELECT company_id, anchor_ms, cast(day AS varchar) AS session_day, driver AS primary_driver, confidence, driver = 'unexplained' AS needs_human_review,
  news_causal, posts_causal, peers_alike, direction, round(z_score, 2) AS z_score FROM attributed""")
def attribute(m: Market) -> DataFrame:
    return _attributed(m).select(
        "company_id", "anchor_ms", F.col("session_day").cast("string").alias("session_day"), "primary_driver", "confidence",
        "needs_human_review", "news_causal", "posts_causal", "peers_alike", "trigger.direction", "trigger.z_score",
    )


@query("at1_attribute_defaults", """
SELECT company_id, driver AS primary_driver, confidence, news_causal, posts_causal, peers_alike FROM attributed""",
       views={"score03": "SELECT * FROM score", "attributed": VIEWS["attributed"].replace(f">= {NEWS_LEAST} THEN 'news'", ">= 1 THEN 'news'")})
def attribute_defaults(m: Market) -> DataFrame:
    """The default thresholds and all news."""
    found = attribution.attribute(score_watchlist(m.bars).filter("flagged"), m.news, m.discussion, m.companies)
    return found.select("company_id", "primary_driver", "confidence", "news_causal", "posts_causal", "peers_alike")


@query("at2_confidence", """
SELECT driver AS primary_driver, confidence, driver = 'unexplained' AS needs_human_review, count(*) AS n FROM attributed GROUP BY ALL""")
def confidence(m: Market) -> DataFrame:
    return _attributed(m).groupBy("primary_driver", "confidence", "needs_human_review").agg(F.count(F.lit(1)).alias("n"))


@query("at3_evidence", """
SELECT a.company_id, cast(e.place AS int) AS place, a.driver AS type, e.ref FROM attributed a JOIN (
  SELECT company_id, 'news' AS driver, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC, id) - 1 AS place, text AS ref FROM news_in WHERE causal
  UNION ALL SELECT company_id, 'discussion', row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC, id) - 1, text FROM posts_in WHERE causal
  UNION ALL SELECT x.company_id, 'sector', row_number() OVER (PARTITION BY x.company_id ORDER BY abs(y.z_score) DESC, y.company_id) - 1, y.company_id
    FROM moves x JOIN moves y ON x.sector = y.sector AND x.direction = y.direction AND x.day = y.day AND x.company_id <> y.company_id
) e USING (company_id, driver) WHERE e.place < 3""")
def evidence(m: Market) -> DataFrame:
    listed = _attributed(m).select("company_id", F.posexplode("evidence").alias("place", "e"))
    return listed.select("company_id", "place", "e.type", "e.ref")


@query("at3_evidence_items", """
SELECT a.company_id, a.driver AS type, e.id AS item_id, e.text AS ref, e.published_at FROM attributed a JOIN (
  SELECT 'news' AS driver, company_id, id, text, published_at FROM news_in WHERE causal
  UNION ALL SELECT 'discussion', company_id, id, text, published_at FROM posts_in WHERE causal) e USING (company_id, driver)""")
def evidence_items(m: Market) -> DataFrame:
    """All items behind the findings whose driver is news or discussion."""
    flagged = score_watchlist(m.bars, z=0.3).filter("flagged")
    return attribution.evidence_items(flagged, m.news, m.discussion, m.companies, ATTRIBUTION)


@query("at3_sector_members", """
SELECT sector, direction, cast(day AS varchar) AS session_day, company_id, name, round(z_score, 6) AS z_score, peers_alike
FROM attributed JOIN company USING (company_id, sector)""")
def sector_members(m: Market) -> DataFrame:
    """The companies that moved alike, each once."""
    members = attribution.sector_members(score_watchlist(m.bars, z=0.3).filter("flagged"), m.companies)
    return members.withColumn("session_day", F.col("session_day").cast("string"))


@query("sink1_refused", f"""
SELECT 'null:headline' AS reason, count(*) AS n FROM ({NEWS_ROWS}) WHERE reason IS NULL AND cast(substring(headline, 6) AS int) % 7 = 0
HAVING count(*) > 0""")
def refused_rows(m: Market) -> DataFrame:
    """Rows without a required value are kept with the reason."""
    rows = feeds.accepted(feeds.ingest_news(m.news_polls))
    holed = rows.withColumn("headline", F.when(F.substring("headline", 6, 9).cast("int") % 7 != 0, F.col("headline")))
    refused = sinks.unusable(holed, "news")
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- graph ------------------------------------------------------------------

_NODES = """
SELECT company_id AS node_id, 'company' AS node_type, NULL AS parent_id, name AS label, NULL AS item_id, NULL::BIGINT AS ordinal FROM company
UNION ALL SELECT parent_id || '-' || kind || '-' || item_id, kind, parent_id, label, item_id,
  row_number() OVER (PARTITION BY parent_id ORDER BY CASE kind WHEN 'news' THEN 0 WHEN 'discussion' THEN 1 ELSE 2 END, place) - 1
FROM (
  SELECT 'news' AS kind, company_id AS parent_id, id AS item_id, headline AS label, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC, id) AS place FROM news
  UNION ALL SELECT 'discussion', company_id, id, title, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC, id) FROM discussion
) WHERE place <= 10
UNION ALL SELECT a.company_id || '-related-' || b.company_id, 'relatedCompany', a.company_id, b.name, b.company_id,
  row_number() OVER (PARTITION BY a.company_id ORDER BY md5(b.company_id)) - 1
    + least(10, (SELECT count(*) FROM news n WHERE n.company_id = a.company_id))
    + least(10, (SELECT count(*) FROM discussion d WHERE d.company_id = a.company_id))
FROM company a JOIN company b ON a.sector IS NOT DISTINCT FROM b.sector AND a.company_id <> b.company_id
WHERE a.company_id IN (SELECT company_id FROM lead)"""


def _nodes(m: Market) -> DataFrame:
    return graph.graph_nodes(m.companies, m.news, m.discussion, lead_movers(m))


@query("gr1_graph_nodes", f"SELECT *, round(ordinal * 0.05::DOUBLE, 6) AS delay_s FROM ({_NODES})")
def graph_nodes(m: Market) -> DataFrame:
    return _nodes(m)


@query("gr2_graph_edges", f"""
SELECT 'edge-' || parent_id || '-' || node_id AS edge_id, parent_id AS src, node_id AS dst FROM ({_NODES}) WHERE parent_id IS NOT NULL""")
def graph_edges(m: Market) -> DataFrame:
    return graph.graph_edges(_nodes(m))


@query("gr3_focus_nodes", f"SELECT node_id, coalesce(parent_id, node_id) <> '7' AS dimmed FROM ({_NODES})")
def focus_nodes(m: Market) -> DataFrame:
    return graph.focus_nodes(_nodes(m), "7").select("node_id", "dimmed")


@query("gr3_focus_edges", f"""
SELECT 'edge-' || parent_id || '-' || node_id AS edge_id, node_id = '7-news-0' AS highlighted FROM ({_NODES}) WHERE parent_id IS NOT NULL""")
def focus_edges(m: Market) -> DataFrame:
    return graph.focus_edges(graph.graph_edges(_nodes(m)), "7-news-0").select("edge_id", "highlighted")


@query("jn7_company_signals", """
SELECT c.company_id, c.name, s.type, s.id, cast(s.rn AS int) AS rank FROM company c JOIN (
  SELECT 'news' AS type, company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC, id) AS rn FROM news
  UNION ALL SELECT 'discussion', company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC, id) FROM discussion
) s USING (company_id) WHERE s.rn <= 10""")
def company_signals(m: Market) -> DataFrame:
    return retrieval.company_signals(m.companies, m.news, m.discussion).select("company_id", "name", "type", "id", "rank")


@query("jn8_valid_edges", f"""
SELECT 'edge-' || parent_id || '-' || node_id AS edge_id FROM ({_NODES}) WHERE parent_id IS NOT NULL
  AND parent_id IN (SELECT company_id FROM gappy WHERE sector IS NOT NULL)""")
def valid_edges(m: Market) -> DataFrame:
    """Edges that stay when one sector's company nodes are gone."""
    nodes = _nodes(m)
    gone = m.gappy_companies.filter(F.col("sector").isNull()).select(F.col("company_id").alias("node_id"))
    return graph.valid_edges(graph.graph_edges(nodes), nodes.join(gone, "node_id", "left_anti")).select("edge_id")


_LATEST_IDS = """SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC, id) AS rn FROM {items}) WHERE rn <= 10"""


@query("jn9_node_diff", f"""
SELECT coalesce(o.id, n.id) AS node_id, CASE WHEN n.id IS NULL THEN 'removed' ELSE 'added' END AS change
FROM ({_LATEST_IDS.format(items="news WHERE published_at < 1705708800000")}) o
FULL JOIN ({_LATEST_IDS.format(items="news")}) n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL""")
def node_diff(m: Market) -> DataFrame:
    """News nodes gone and new between 20 January and the end of the data."""
    def ids(news: DataFrame) -> DataFrame:
        return retrieval.latest_signals(news).select(F.col("id").alias("node_id"))
    return graph.node_diff(ids(m.news.filter(F.col("published_at") < 1_705_708_800_000)), ids(m.news))


_RANKED = """SELECT id, company_id, headline, published_at, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC, id) AS place FROM {items}"""


@query("jn9_changed_nodes", f"""
SELECT coalesce(o.id, n.id) AS node_id, CASE WHEN n.id IS NULL THEN 'removed' WHEN o.id IS NULL THEN 'added' ELSE 'changed' END AS change
FROM (SELECT * FROM ({_RANKED.format(items="news WHERE published_at < 1705708800000")}) WHERE place <= 5) o
FULL JOIN (SELECT * FROM ({_RANKED.format(items="news")}) WHERE place <= 5) n ON o.id = n.id
WHERE o.id IS NULL OR n.id IS NULL OR o.place <> n.place""")
def changed_nodes(m: Market) -> DataFrame:
    """News nodes, with their place among their company's newest five, between two stored snapshots."""
    base = fresh_dir(m.spark, "snapshots")

    def nodes(news: DataFrame) -> DataFrame:
        newest = top_n(news, ["company_id"], [F.desc("published_at"), F.asc("id")], 5, "place")
        return newest.select(F.col("id").alias("node_id"), "company_id", "headline", "published_at", "place")
    now = nodes(m.news)
    graph.store_snapshot(nodes(m.news.filter(F.col("published_at") < 1_705_708_800_000)), f"{base}/old", 16)
    graph.store_snapshot(now, f"{base}/new", 16)
    return graph.snapshot_diff(m.spark, f"{base}/old", f"{base}/new", now.schema)
