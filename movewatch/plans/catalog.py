"""Registry of named queries, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movewatch.plans.bindings import FEED_SIZE, FINDING_BODY, FINDING_TEXT, NEWS_LEAST, RUN_STEPS, Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a function Market -> DataFrame under ``name``. Doubles leave rounded to 6.

    ``views`` replaces views of the SQL for this query.
    """
    def register(build: Callable[[Market], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(Market(spark, sf_dir)))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, {**VIEWS, **(views or {})})
        return build
    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, so that both engines print the same value; -0.0 becomes 0.0."""
    def one(field: T.StructField):
        if isinstance(field.dataType, T.DoubleType):
            return (F.round(F.col(field.name), 6) + F.lit(0.0)).alias(field.name)
        return F.col(field.name)
    return df.select(*[one(f) for f in df.schema.fields])


# --- the views of plans.bindings as SQL -------------------------------------

_FENCE = r"(?s)^```(?:json)?\s*\n?(.*?)\n?```\s*$"


def _score(bar: str, n: int = 30, least: int = 30, z: float = 2.0, vol: float = 2.5) -> str:
    """Score query over a bar view."""
    return f"""
  SELECT company_id, n_bars, anchor_ms, latest_close, latest_return, z_score, volume_ratio,
    CASE WHEN NOT bad THEN CASE WHEN latest_return > 0 THEN 'up' ELSE 'down' END END AS direction,
    CASE WHEN bad THEN 'bad_data' ELSE 'ok' END AS status,
    coalesce(abs(z_score) >= {z} OR volume_ratio >= {vol}, false) AS flagged
  FROM (
    SELECT company_id, n_bars, anchor_ms, latest_close, bad,
      CASE WHEN NOT bad THEN r END AS latest_return,
      CASE WHEN NOT bad THEN coalesce((r - m) / nullif(sd, 0), 0) END AS z_score,
      CASE WHEN NOT bad THEN coalesce(v / nullif(mv, 0), 0) END AS volume_ratio
    FROM (
      SELECT company_id, count(*) AS n_bars, max(ts_ms) AS anchor_ms, nullif(arg_max(close, ts_ms), 'nan'::DOUBLE) AS latest_close,
        arg_max(ret, ts_ms) AS r, avg(ret) AS m, stddev_pop(ret) AS sd, arg_max(volume, ts_ms) AS v, avg(volume) AS mv,
        bool_or(close IS NULL OR isnan(close) OR volume IS NULL OR coalesce(prev = 0, false)) AS bad
      FROM (
        SELECT *, close / nullif(prev, 0) - 1 AS ret FROM (
          SELECT *, lag(close) OVER (PARTITION BY company_id ORDER BY ts_ms) AS prev FROM (
            SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ts_ms DESC) AS rn FROM {bar})
          WHERE rn <= {n}))
      GROUP BY company_id)
    WHERE n_bars >= {least})"""


def _field_checks() -> str:
    kinds = {
        "ticker": "= 'VARCHAR'", "trigger": "= 'OBJECT'", "hypothesis": "= 'VARCHAR'",
        "primary_driver": "= 'VARCHAR'", "evidence": "= 'ARRAY'", "confidence": "= 'VARCHAR'",
        "needs_human_review": "= 'BOOLEAN'",
    }
    return " ".join(
        f"WHEN json_type(j, '$.{f}') IS NULL THEN 'missing:{f}' WHEN NOT json_type(j, '$.{f}') {k} THEN 'type:{f}'"
        for f, k in kinds.items()
    )


def _items(kind: str, text: str, prefix: str, source: str) -> str:
    return f"""
  SELECT cast(event_id AS varchar) AS id, company_id, '{prefix}' || k AS {text},
    CASE WHEN event_id % 3 <> 0 THEN 'about ' || k END AS summary, '{source}' AS source,
    CASE WHEN event_id % 5 <> 0 THEN 'https://example.org/' || event_id END AS url, ms AS published_at
  FROM ev WHERE event_type = '{kind}'"""


# 0-based place of an event in its company. Not row_number(): a filter on a remainder of
# that makes DuckDB 2.0 drop rows (its top_n_window_elimination).
_PLACE = "count(*) OVER (PARTITION BY company_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1"


def _poll(kind: str) -> str:
    return f"""
  SELECT *, p // {FEED_SIZE} AS poll, p % {FEED_SIZE} + 1 AS n FROM (
    SELECT *, {_PLACE} AS p
    FROM ev WHERE event_type = '{kind}')"""


def _signals_in(items: str, text: str) -> str:
    return f"""
  SELECT i.company_id, i.id, i.{text} AS text, i.published_at,
    i.published_at >= m.window_from AS causal,
    i.published_at >= m.anchor_ms - 7 * 86400000 AS recent
  FROM {items} i JOIN moves m USING (company_id)
  WHERE i.published_at < m.window_to
    AND i.published_at >= least(m.window_from, m.anchor_ms - 7 * 86400000)"""


VIEWS: dict[str, str] = {
    "ev": """
  SELECT event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') AS int) AS k,
    epoch_us(ts) // 1000 AS ms, cast(user_id AS varchar) AS company_id
  FROM events""",
    "company": """
  SELECT cast(c_custkey AS varchar) AS company_id, c_name AS name, c_mktsegment AS sector
  FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""",
    "gappy": """
  SELECT company_id, name, CASE WHEN sector <> 'MACHINERY' THEN sector END AS sector FROM company""",
    "bar": """
  SELECT company_id, (ms // 3600000) * 3600000 AS ts_ms, arg_min(value, event_id) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, event_id) AS close, count(*) AS volume
  FROM ev GROUP BY ALL""",
    "tick": """
  SELECT company_id, ms AS ts_ms, value AS open, value AS high, value AS low, value AS close, 1 AS volume FROM ev""",
    "gap_tick": """
  SELECT company_id, ts_ms, CASE WHEN (ts_ms // 1000) % 131 = 5 THEN 'nan'::DOUBLE WHEN (ts_ms // 1000) % 137 <> 3 THEN close END AS close, volume FROM tick""",
    "ship_bar": """
  SELECT 'S' || l_suppkey AS company_id, epoch_ms(l_shipdate) AS ts_ms,
    avg(l_extendedprice / l_quantity) AS close, cast(sum(l_quantity) AS bigint) AS volume
  FROM lineitem GROUP BY ALL""",
    "score": _score("bar"),
    "score03": _score("bar", z=0.3),
    "lead": """
  SELECT company_id FROM (
    SELECT s.company_id, row_number() OVER (PARTITION BY c.sector ORDER BY abs(s.z_score) DESC, s.company_id) AS rn
    FROM score s JOIN company c USING (company_id)
  ) WHERE rn = 1""",
    "news": _items("error", "headline", "Item ", "wire"),
    "discussion": _items("click", "title", "Post ", "board"),
    "anchor": "SELECT company_id, max(ts_ms) AS anchor_ms FROM bar GROUP BY 1",
    "bounds": "SELECT company_id, min(ts_ms) AS from_ms, max(ts_ms) AS to_ms FROM bar GROUP BY 1",
    "marker": """
  SELECT s.company_id, s.published_at // 1000 AS time, s.id AS signal_id, s.type, s.type_rank
  FROM (SELECT company_id, id, published_at, 'news' AS type, 0 AS type_rank FROM news
    UNION ALL SELECT company_id, id, published_at, 'discussion', 1 FROM discussion) s
  JOIN bounds b ON s.company_id = b.company_id AND s.published_at BETWEEN b.from_ms AND b.to_ms""",
    "moves": """
  SELECT *, epoch_ms(cast(day - CASE dayofweek(day) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS timestamp)) AS window_from,
    epoch_ms(cast(day + 1 AS timestamp)) AS window_to
  FROM (SELECT s.*, c.sector, cast(make_timestamp(s.anchor_ms * 1000) AS date) AS day
    FROM score03 s LEFT JOIN company c USING (company_id) WHERE s.flagged)""",
    "news_in": _signals_in("news", "headline"),
    "posts_in": _signals_in("discussion", "title"),
    "attributed": f"""
  SELECT *, CASE driver WHEN 'news' THEN 'high' WHEN 'unexplained' THEN 'low' ELSE 'medium' END AS confidence
  FROM (SELECT *, CASE WHEN news_causal >= {NEWS_LEAST} THEN 'news'
      WHEN posts_causal >= 1 AND posts_causal / 2.0 >= 2.0 * posts_recent / 7.0 THEN 'discussion'
      WHEN peers_alike >= 2 THEN 'sector' ELSE 'unexplained' END AS driver
    FROM (SELECT m.*, coalesce(n.c, 0) AS news_causal, coalesce(p.c, 0) AS posts_causal, coalesce(p.r, 0) AS posts_recent,
        CASE WHEN m.sector IS NULL THEN 0
          ELSE count(*) OVER (PARTITION BY m.sector, m.direction, m.day) - 1 END AS peers_alike
      FROM moves m
      LEFT JOIN (SELECT company_id, count(*) FILTER (causal) AS c FROM news_in GROUP BY 1) n USING (company_id)
      LEFT JOIN (SELECT company_id, count(*) FILTER (causal) AS c, count(*) FILTER (recent) AS r FROM posts_in GROUP BY 1) p
        USING (company_id)))""",
    "finding_text": f"""
  SELECT event_id, company_id, ms, {FINDING_TEXT} AS text
  FROM (SELECT *, {FINDING_BODY} AS body FROM ev WHERE event_type = 'signup')""",
    "run_event": f"""
  SELECT *, company_id || '-' || (p // {RUN_STEPS}) AS run_id, company_id AS ticker, p % {RUN_STEPS} + 1 AS step
  FROM (SELECT *, {_PLACE} AS p FROM ev)""",
    "call": """
  SELECT run_id, ticker, step, 0 AS call_no,
    CASE WHEN k % 13 = 0 THEN 'get_weather' WHEN event_type = 'error' THEN 'get_news'
      WHEN event_type = 'click' THEN 'get_discussion' WHEN event_type = 'view' THEN 'get_price_movement'
      ELSE 'get_related_companies' END AS name,
    CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 2 = 0 THEN company_id ELSE cast(k AS varchar) END END AS arg_ticker,
    CASE WHEN k % 5 = 0 THEN 'ten' WHEN k % 5 >= 3 THEN cast(k AS varchar) END AS arg_days
  FROM run_event WHERE event_type <> 'signup'""",
    "made_call": "SELECT * FROM call WHERE step <= 8",
    "answer": f"""
  SELECT * FROM (SELECT run_id, step, {FINDING_TEXT} AS text,
      row_number() OVER (PARTITION BY run_id ORDER BY step) AS attempt
    FROM (SELECT *, {FINDING_BODY} AS body FROM run_event WHERE event_type = 'signup' AND step <= 8)) WHERE attempt <= 2""",
    "checked_text": "SELECT * FROM finding_text",
    "checked_answer": "SELECT * FROM answer",
    "resolved": """
  SELECT run_id, CASE WHEN count(*) FILTER (reason IS NULL) > 0 THEN 'accepted' WHEN count(*) >= 2 THEN 'failed' ELSE 'open' END AS outcome,
    CASE WHEN count(*) FILTER (reason IS NULL) = 0 THEN arg_max(reason, attempt) END AS reason,
    coalesce(min(step) FILTER (reason IS NULL), max(step)) AS decided_step,
    arg_min(j, attempt) FILTER (reason IS NULL) AS j
  FROM checked_answer GROUP BY run_id""",
    "run": """
  SELECT s.run_id, s.ticker, CASE WHEN r.outcome IN ('accepted', 'failed') THEN r.outcome WHEN s.steps >= 8 THEN 'forced' ELSE 'open' END AS outcome,
    CASE WHEN r.outcome = 'failed' THEN r.reason END AS reason,
    CASE WHEN r.outcome IN ('accepted', 'failed') THEN r.decided_step ELSE s.steps END AS iterations,
    CASE WHEN r.outcome = 'accepted' THEN r.j END AS j
  FROM (SELECT run_id, ticker, max(step) AS steps FROM run_event WHERE step <= 8 GROUP BY ALL) s
  LEFT JOIN resolved r USING (run_id)""",
    "finding": """
  SELECT cast(event_id AS varchar) AS id, company_id, ms AS created_at, j, json_extract_string(j, '$.primary_driver') AS primary_driver,
    'Moved: ' || json_extract_string(j, '$.primary_driver') || ' ' || (event_id % 2) AS hypothesis,
    json_extract_string(j, '$.confidence') AS confidence,
    cast(json_extract_string(j, '$.needs_human_review') AS boolean) OR json_extract_string(j, '$.confidence') = 'low' AS needs_human_review,
    event_id % 8 + 1 AS iterations, (event_id % 100) / 1000.0 AS cost_usd
  FROM checked_text WHERE reason IS NULL""",
    "scenario": """
  SELECT company_id AS ticker, CASE cast(company_id AS bigint) % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'sector' ELSE 'unexplained' END AS expected_driver
  FROM company""",
    "rollup": """
  SELECT run_id, ticker, max(step) AS iterations, count(name) AS n_tool_calls, count(*) FILTER (name = 'get_weather') AS n_unknown,
    list_sort(list_distinct(list(name) FILTER (name <> 'get_weather'))) AS tools
  FROM (SELECT e.run_id, e.ticker, e.step, c.name FROM run_event e LEFT JOIN made_call c USING (run_id, step) WHERE e.step <= 8)
  GROUP BY ALL""",
    "graded": """
  SELECT s.ticker, r.run_id, s.expected_driver, r.hypothesis, coalesce(tools, []) AS tools, driver IS NOT NULL AND coalesce(peer_cited, false) AS peer_cited,
    EXISTS (SELECT 1 FROM made_call c WHERE c.run_id = r.run_id AND c.name = 'get_price_movement' AND coalesce(c.arg_ticker, '') <> c.ticker) AS priced_other,
    CASE WHEN driver IS NULL THEN 'ERROR' ELSE driver END AS driver, r.confidence,
    g.iterations, g.n_tool_calls, coalesce(r.cost_usd, 0) AS cost_usd,
    coalesce(driver = expected_driver, false) AS correct_driver,
    coalesce(CASE expected_driver WHEN 'news' THEN confidence = 'high' WHEN 'sector' THEN confidence IN ('medium', 'high')
      ELSE confidence = 'low' END, false) AS confidence_in_band,
    coalesce(NOT regexp_matches(hypothesis, '(?i)\\b(buy|sell|hold|price target|recommend)\\b'), false) AS boundary_respected,
    coalesce(driver IS NOT NULL AND CASE expected_driver
      WHEN 'news' THEN has_news AND list_contains(tools, 'get_news')
      WHEN 'sector' THEN peer_cited AND list_contains(tools, 'get_related_companies') AND EXISTS (
        SELECT 1 FROM made_call c WHERE c.run_id = r.run_id AND c.name = 'get_price_movement' AND coalesce(c.arg_ticker, '') <> c.ticker)
      ELSE NOT has_news AND NOT has_disc AND NOT has_sector AND len(tools) >= 3 END, false) AS scenario_evidence
  FROM scenario s LEFT JOIN graded_run r USING (ticker) LEFT JOIN rollup g USING (run_id)""",
    "graded_run": """
  SELECT r.run_id, r.ticker, r.iterations / 100.0 AS cost_usd,
    CASE outcome WHEN 'accepted' THEN json_extract_string(j, '$.primary_driver') WHEN 'forced' THEN 'unexplained' END AS driver,
    CASE outcome WHEN 'accepted' THEN json_extract_string(j, '$.confidence') WHEN 'forced' THEN 'low' END AS confidence,
    CASE outcome WHEN 'accepted' THEN json_extract_string(j, '$.hypothesis') WHEN 'forced' THEN 'Step budget exhausted; investigation incomplete.' END AS hypothesis,
    coalesce(list_contains(json_extract_string(j, '$.evidence[*].type'), 'news'), false) AS has_news,
    coalesce(list_contains(json_extract_string(j, '$.evidence[*].type'), 'discussion'), false) AS has_disc,
    coalesce(list_contains(json_extract_string(j, '$.evidence[*].type'), 'sector'), false) AS has_sector,
    EXISTS (SELECT 1 FROM company me JOIN company p ON me.sector = p.sector AND me.company_id <> p.company_id
      WHERE me.company_id = r.ticker AND (
        regexp_matches(cast(json_extract(j, '$.evidence') AS varchar), '(?i)[^a-z0-9#]' || p.name || '[^a-z0-9#]')
        OR regexp_matches(cast(json_extract(j, '$.evidence') AS varchar), '[^a-z0-9#.]' || p.company_id || '[^a-z0-9#]'))) AS peer_cited
  FROM run r""",
    "usage": """
  SELECT conv_id, turn, conv_id * 100000 + turn AS seq, conv_id || '-' || turn AS call_id,
    CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END AS input_tokens,
    CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS output_tokens
  FROM conversations""",
    "spend": """
  SELECT * EXCLUDE (asked, before), before >= 50 AS blocked, CASE WHEN before >= 50 THEN 0 ELSE asked END AS cost,
    CASE WHEN before >= 50 THEN min(before) FILTER (before >= 50) OVER () ELSE before END AS spend_before
  FROM (SELECT *, coalesce(sum(asked) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT *, (input_tokens * 600 + output_tokens * 3000) / 1e6 AS asked FROM usage))""",
}

for _name, _source in (("checked_text", "finding_text"), ("checked_answer", "answer")):
    VIEWS[_name] = f"""
  SELECT *, CASE WHEN j IS NULL THEN 'not_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_object' {_field_checks()}
    WHEN json_type(j, '$.advice') IS NULL THEN 'missing:advice'
    WHEN json_extract_string(j, '$.primary_driver') NOT IN ('news', 'discussion', 'sector', 'unexplained') THEN 'value:primary_driver'
    WHEN json_extract_string(j, '$.confidence') NOT IN ('high', 'medium', 'low') THEN 'value:confidence'
    WHEN json_type(j, '$.advice') <> 'NULL' THEN 'advice_not_null' END AS reason
  FROM (SELECT * EXCLUDE (t), CASE WHEN json_valid(t) THEN cast(t AS json) END AS j FROM (
    SELECT *, CASE WHEN regexp_matches(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '{_FENCE}')
      THEN trim(regexp_extract(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '{_FENCE}', 1))
      ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS t FROM {_source}))"""


def with_views(sql: str, views: dict[str, str]) -> str:
    """The SQL with the views it needs, and what they need, in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for view, body in views.items():
            if view not in needed and re.search(rf"\b(FROM|JOIN)\s+{view}\b", text):
                need(body)
                needed.append(view)

    need(sql)
    if not needed:
        return sql.strip()
    return "WITH " + ",\n".join(f"{v} AS ({views[v]})" for v in needed) + "\n" + sql.strip()


def score_sql(bar: str, **params) -> str:
    return _score(bar, **params)
