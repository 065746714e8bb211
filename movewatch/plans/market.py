"""Queries over bars: scan, movement, series, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movewatch.operators import anomaly, attribution, bars, retrieval
from movewatch.operators.ordered import top_n
from movewatch.plans.bindings import AS_OF_MS, NEWS_LEAST, Market
from movewatch.plans.catalog import VIEWS, query, score_sql
from movewatch.session import fresh_dir
from movewatch.sources import digests, sinks

_SCORE_COLUMNS = """company_id, n_bars, anchor_ms, round(latest_close, 6) AS latest_close, round(latest_return, 6) AS latest_return,
  round(z_score, 6) AS z_score, round(volume_ratio, 6) AS volume_ratio, direction, status, flagged"""
_TRIGGER_COLUMNS = """company_id, round(z_score, 2) AS z_score, round(volume_ratio, 2) AS volume_ratio, direction,
  round(latest_return * 100, 2) AS latest_return_pct"""


def _flat_trigger(df: DataFrame) -> DataFrame:
    return df.select("company_id", "trigger.*")


def lead_movers(m: Market) -> DataFrame:
    """The company with the largest |z| of each sector: the ones under investigation."""
    scored = anomaly.score_watchlist(m.bars).join(m.companies, "company_id")
    return top_n(scored, ["sector"], [F.desc(F.abs("z_score")), F.asc("company_id")], 1).select("company_id")


@query("an1_score_watchlist", f"SELECT {_SCORE_COLUMNS} FROM score")
def score_watchlist(m: Market) -> DataFrame:
    return anomaly.score_watchlist(m.bars)


@query("an1_scan_watchlist", f"SELECT {_TRIGGER_COLUMNS} FROM score WHERE flagged")
def scan_watchlist(m: Market) -> DataFrame:
    return _flat_trigger(anomaly.scan_watchlist(m.bars))


@query("an1_scan_companies", f"SELECT {_TRIGGER_COLUMNS} FROM score WHERE flagged AND company_id IN (SELECT company_id FROM company)")
def scan_companies(m: Market) -> DataFrame:
    return _flat_trigger(anomaly.scan_watchlist(m.bars, m.companies))


# latest_close is left out: a mean of two-decimal prices may sit on a rounding edge.
@query("an1_score_shipments", f"""
SELECT company_id, n_bars, anchor_ms, round(latest_return, 6) AS latest_return, round(z_score, 6) AS z_score,
  round(volume_ratio, 6) AS volume_ratio, direction, status, flagged FROM ({score_sql('ship_bar')})""")
def score_shipments(m: Market) -> DataFrame:
    return anomaly.score_watchlist(m.ship_bars).drop("latest_close")


@query("an1_score_ticks", f"SELECT {_SCORE_COLUMNS} FROM ({score_sql('tick')})")
def score_ticks(m: Market) -> DataFrame:
    return anomaly.score_watchlist(m.ticks)


@query("an1_score_gaps", f"SELECT {_SCORE_COLUMNS} FROM ({score_sql('gap_tick')})")
def score_gaps(m: Market) -> DataFrame:
    """Companies with a missing close among their bars are bad data and never flagged."""
    return anomaly.score_watchlist(m.gap_ticks)


_MOVEMENT = """
SELECT c.company_id, coalesce(n_bars, 0) AS n_bars,
  round(CASE WHEN n_bars >= 2 THEN round(latest_close, 4) ELSE latest_close END, 6) AS latest_close,
  round(CASE WHEN scored THEN ret * 100 END, 4) AS latest_return_pct,
  round(CASE WHEN scored THEN coalesce((ret - mu) / nullif(sd, 0), 0) END, 4) AS z_score,
  round(CASE WHEN scored THEN coalesce(v / nullif(mv, 0), 0) END, 4) AS volume_ratio,
  CASE WHEN scored THEN CASE WHEN ret > 0 THEN 'up' ELSE 'down' END END AS direction
FROM company c LEFT JOIN (
  SELECT company_id, count(*) AS n_bars, arg_max(close, ts_ms) AS latest_close, arg_max(r, ts_ms) AS ret,
    avg(r) AS mu, stddev_pop(r) AS sd, arg_max(volume, ts_ms) AS v, avg(volume) AS mv,
    count(*) >= 2 AND NOT bool_or(coalesce(prev = 0, false)) AS scored
  FROM (SELECT *, close / nullif(prev, 0) - 1 AS r FROM (
    SELECT b.*, lag(close) OVER (PARTITION BY b.company_id ORDER BY ts_ms) AS prev
    FROM bar b JOIN anchor a USING (company_id) WHERE ts_ms >= anchor_ms - 2592000000))
  GROUP BY company_id) s USING (company_id)"""


@query("an2_price_movement", _MOVEMENT)
def price_movement(m: Market) -> DataFrame:
    return anomaly.price_movement(m.bars, m.companies)


@query("an3_compute_trigger", f"SELECT {_TRIGGER_COLUMNS} FROM ({score_sql('bar', least=2)})")
def compute_trigger(m: Market) -> DataFrame:
    return _flat_trigger(anomaly.compute_trigger(m.bars))


@query("an4_all_fired", """
SELECT count(*) AS scored, count(*) FILTER (flagged) AS fired, coalesce(bool_and(flagged), false) AS all_fired FROM score""")
def all_fired(m: Market) -> DataFrame:
    return anomaly.assert_all_flagged(anomaly.score_watchlist(m.bars))


@query("ag1_anchors", "SELECT company_id, anchor_ms FROM anchor")
def anchors(m: Market) -> DataFrame:
    return bars.anchors(m.bars)


@query("ag4_day_change", f"""
SELECT company_id, n_bars, round(pct, 6) AS pct, pct >= 0 AS positive FROM (
  SELECT company_id, count(*) AS n_bars,
    CASE WHEN count(*) >= 2 THEN (arg_max(close, ts_ms) - arg_min(close, ts_ms)) / nullif(arg_min(close, ts_ms), 0) * 100 END AS pct
  FROM bar WHERE ts_ms >= {AS_OF_MS} - 86400000 GROUP BY 1)""")
def day_change(m: Market) -> DataFrame:
    return bars.day_change(bars.in_range(m.bars, "1D", AS_OF_MS))


@query("ag5_latest_price", "SELECT company_id, round(arg_max(close, ts_ms), 6) AS latest_close FROM bar GROUP BY 1")
def latest_price(m: Market) -> DataFrame:
    return bars.latest_price(m.bars)


@query("ag6_price_bounds", "SELECT company_id, from_ms, to_ms FROM bounds")
def price_bounds(m: Market) -> DataFrame:
    return bars.price_bounds(m.bars)


@query("ag7_series", """
SELECT company_id, p // 25 AS chunk_no, cast(p % 25 AS int) AS place, ts_ms AS timestamp, round(close, 6) AS close, volume
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ts_ms) - 1 AS p FROM bar)""")
def series(m: Market) -> DataFrame:
    chunks = bars.series(m.bars, chunk=25)
    points = chunks.select("company_id", "chunk_no", F.posexplode("series").alias("place", "p"))
    return points.select("company_id", "chunk_no", "place", "p.*")


@query("an2_movement_series", """
SELECT company_id, p // 25 AS chunk_no, cast(p % 25 AS int) AS place, ts_ms AS timestamp, round(close, 6) AS close, volume
FROM (SELECT b.*, row_number() OVER (PARTITION BY b.company_id ORDER BY ts_ms) - 1 AS p FROM bar b JOIN anchor a USING (company_id)
  WHERE ts_ms >= anchor_ms - 10 * 86400000)""")
def movement_series(m: Market) -> DataFrame:
    """The bars behind the price movements of ten days."""
    chunks = bars.series(anomaly.movement_window(m.bars, days=10), chunk=25)
    points = chunks.select("company_id", "chunk_no", F.posexplode("series").alias("place", "p"))
    return points.select("company_id", "chunk_no", "place", "p.*")


@query("wn1_returns", """
SELECT company_id, ts_ms, round(close, 6) AS close, round(prev_close, 6) AS prev_close, round(close / nullif(prev_close, 0) - 1, 6) AS ret
FROM (SELECT *, lag(close) OVER (PARTITION BY company_id ORDER BY ts_ms) AS prev_close FROM bar)""")
def returns(m: Market) -> DataFrame:
    return bars.with_returns(m.bars).select("company_id", "ts_ms", "close", "prev_close", "ret")


@query("wn2_last_n_bars", """
SELECT company_id, ts_ms, round(close, 6) AS close, volume, cast(rn AS int) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ts_ms DESC) AS rn FROM bar) WHERE rn <= 30""")
def last_n_bars(m: Market) -> DataFrame:
    return bars.last_n(m.bars, 30, "rn").select("company_id", "ts_ms", "close", "volume", "rn")


@query("wn3_short_history", f"SELECT company_id, n_bars FROM ({score_sql('bar', n=40, least=35)})")
def short_history(m: Market) -> DataFrame:
    return anomaly.score_watchlist(m.bars, n=40, min_bars=35).select("company_id", "n_bars")


@query("tk3_price_range", f"""
SELECT company_id, ts_ms, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume
FROM bar WHERE ts_ms >= {AS_OF_MS} - 7 * 86400000""")
def price_range(m: Market) -> DataFrame:
    return bars.price_range(m.bars, "1W", AS_OF_MS)


@query("tk5_company_sessions", """
SELECT company_id, cast(s AS int) AS session_no, ts_ms FROM (
  SELECT company_id, epoch_ms(d + INTERVAL 20 HOUR) AS ts_ms, row_number() OVER (PARTITION BY company_id ORDER BY d DESC) AS back,
    30 - row_number() OVER (PARTITION BY company_id ORDER BY d DESC) AS s
  FROM (SELECT company_id, unnest(generate_series(cast(make_timestamp(anchor_ms * 1000) AS date) - INTERVAL 64 DAY,
      cast(make_timestamp(anchor_ms * 1000) AS date), INTERVAL 1 DAY)) AS d FROM anchor)
  WHERE dayofweek(d) BETWEEN 1 AND 5) WHERE back <= 30""")
def company_sessions(m: Market) -> DataFrame:
    return bars.company_sessions(bars.anchors(m.bars), 30)


@query("sc16_candles", """
SELECT company_id, ts_ms // 1000 AS time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close FROM bar""")
def candles(m: Market) -> DataFrame:
    return bars.chart_series(m.bars)


@query("sc16_line", "SELECT company_id, ts_ms // 1000 AS time, round(close, 6) AS value FROM bar")
def line(m: Market) -> DataFrame:
    return bars.chart_series(m.bars, "line")


@query("rm1_resample_daily", """
SELECT company_id, (ts_ms // 86400000) * 86400000 AS ts_ms, round(arg_min(open, ts_ms), 6) AS open, round(max(high), 6) AS high,
  round(min(low), 6) AS low, round(arg_max(close, ts_ms), 6) AS close, cast(sum(volume) AS bigint) AS volume
FROM bar b GROUP BY company_id, b.ts_ms // 86400000""")
def resample_daily(m: Market) -> DataFrame:
    return bars.resample_daily(m.bars)


@query("an2_stored_movement", _MOVEMENT)
def stored_movement(m: Market) -> DataFrame:
    """The same from stored bars and their daily digests: bars come in two batches, a third of them late."""
    base = fresh_dir(m.spark, "movement")
    bars_path, path = f"{base}/bars", f"{base}/digests"
    late = F.pmod(F.xxhash64("company_id", "ts_ms"), F.lit(3)) == 0
    for part in (~late, late):
        digests.append_bars(m.bars.filter(part), bars_path, path, [F.asc("close")])
    return digests.price_movement(m.spark, bars_path, path, m.companies)


_BACK = "OVER (PARTITION BY company_id ORDER BY ts_ms ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query("rm1_backfill_scores", f"""
SELECT company_id, anchor_ms, n_bars, round(nullif(close, 'nan'::DOUBLE), 6) AS latest_close, round(CASE WHEN NOT bad THEN ret END, 6) AS latest_return,
  round(CASE WHEN NOT bad THEN coalesce((ret - m) / nullif(sd, 0), 0) END, 6) AS z_score,
  round(CASE WHEN NOT bad THEN coalesce(volume / nullif(mv, 0), 0) END, 6) AS volume_ratio,
  CASE WHEN NOT bad THEN CASE WHEN ret > 0 THEN 'up' ELSE 'down' END END AS direction, CASE WHEN bad THEN 'bad_data' ELSE 'ok' END AS status,
  coalesce(NOT bad AND (abs(coalesce((ret - m) / nullif(sd, 0), 0)) >= 2.0 OR coalesce(volume / nullif(mv, 0), 0) >= 2.5), false) AS flagged
FROM (SELECT company_id, ts_ms AS anchor_ms, close, volume, ret, count(*) {_BACK.format(29)} AS n_bars,
    avg(r) {_BACK.format(28)} AS m, stddev_pop(r) {_BACK.format(28)} AS sd, avg(volume) {_BACK.format(29)} AS mv,
    bool_or(close IS NULL OR isnan(close) OR volume IS NULL) {_BACK.format(29)} OR bool_or(coalesce(prev = 0, false)) {_BACK.format(28)} AS bad
  FROM (SELECT *, close / nullif(prev, 0) - 1 AS ret, CASE WHEN NOT isnan(close / nullif(prev, 0)) THEN close / nullif(prev, 0) - 1 END AS r
    FROM (SELECT *, lag(close) OVER (PARTITION BY company_id ORDER BY ts_ms) AS prev FROM gap_tick)))
WHERE n_bars >= 30""")
def backfill_scores(m: Market) -> DataFrame:
    """The score of every company at every tick that has 30 ticks behind it."""
    return anomaly.backfill_scores(m.gap_ticks)


@query("st1_watchlist", """
SELECT company_id, cast(min(list_no * 1000000000000 + ordinal) // 1000000000000 AS int) AS list_no, min(list_no * 1000000000000 + ordinal) % 1000000000000 AS ordinal FROM (
  SELECT company_id, 0 AS list_no, min(event_id) AS ordinal FROM ev WHERE event_type = 'purchase' GROUP BY 1
  UNION ALL SELECT company_id, 1, min(event_id) FROM ev WHERE event_type = 'view' GROUP BY 1) GROUP BY 1""")
def watchlist(m: Market) -> DataFrame:
    def seen(kind: str) -> DataFrame:
        e = m.events.filter(F.col("event_type") == kind)
        return e.groupBy("company_id").agg(F.min("event_id").alias("ordinal"))
    return retrieval.watchlist(seen("purchase"), seen("view"))


# One cycle with the default thresholds.
_DEFAULTS = {"score03": "SELECT * FROM score", "attributed": VIEWS["attributed"].replace(f">= {NEWS_LEAST} THEN 'news'", ">= 1 THEN 'news'")}


def _cycle(m: Market, flagged: DataFrame) -> DataFrame:
    found = attribution.attribute(flagged, m.news, m.discussion, m.companies)
    return sinks.finding_rows(found, F.col("anchor_ms"))


@query("ag8_scan_summary", """
SELECT (SELECT count(*) FROM company) AS scanned, (SELECT count(*) FROM score WHERE flagged) AS flagged,
  (SELECT count(*) FROM attributed) AS findings""", views=_DEFAULTS)
def scan_summary(m: Market) -> DataFrame:
    flagged = anomaly.score_watchlist(m.bars).filter("flagged")
    return retrieval.scan_summary(m.companies, flagged, _cycle(m, flagged))


@query("ag8_cycle_findings", """
SELECT company_id, anchor_ms AS created_at, driver AS primary_driver, confidence FROM attributed""", views=_DEFAULTS)
def cycle_findings(m: Market) -> DataFrame:
    """The findings of one scan cycle, as rows."""
    rows = _cycle(m, anomaly.score_watchlist(m.bars).filter("flagged"))
    return rows.select("company_id", "created_at", "primary_driver", "confidence")
