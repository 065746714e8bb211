"""Queries over findings, runs, evaluation and spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movewatch.functions import scalar
from movewatch.operators import evaluation, findings, usage
from movewatch.operators.attribution import AttributionParams, attribute
from movewatch.operators.anomaly import score_watchlist
from movewatch.plans.bindings import AS_OF_MS, NEWS_LEAST, Market
from movewatch.plans.catalog import query
from movewatch.sources import sinks, tables

ATTRIBUTION = AttributionParams(min_news=NEWS_LEAST)

# --- text functions ---------------------------------------------------------

_STRIPPED = """
SELECT event_id, CASE WHEN regexp_matches(t, '(?s)^```(?:json)?\\s*\\n?(.*?)\\n?```\\s*$')
  THEN trim(regexp_extract(t, '(?s)^```(?:json)?\\s*\\n?(.*?)\\n?```\\s*$', 1)) ELSE t END AS text
FROM (SELECT event_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM finding_text)"""


@query("sc11_strip_fence", _STRIPPED)
def strip_fence(m: Market) -> DataFrame:
    return m.finding_texts.select("event_id", scalar.strip_fence("text").alias("text"))


def _whole_words(words: str) -> str:
    return f"(?i)(^|[^\\pL\\pN\\pM_])({words})($|[^\\pL\\pN\\pM_])"


@query("sc12_advice_in_findings", f"""
SELECT event_id, regexp_matches(text, '{_whole_words("buy|sell|hold|price target|recommend")}') AS advice FROM finding_text""")
def advice_in_findings(m: Market) -> DataFrame:
    return m.finding_texts.select("event_id", scalar.has_advice("text").alias("advice"))


_DOC_WORDS = ("license", "with", "que", "und")


@query("sc12_advice_in_documents", f"""
SELECT doc_id, regexp_matches(text, '{_whole_words("buy|sell|hold|price target|recommend")}') AS advice,
  regexp_matches(text, '{_whole_words("|".join(_DOC_WORDS))}') AS listed FROM documents""")
def advice_in_documents(m: Market) -> DataFrame:
    """Whole texts against the advice words and against another word list."""
    return m.table("documents").select(
        "doc_id", scalar.has_advice("text").alias("advice"), scalar.has_advice("text", _DOC_WORDS).alias("listed")
    )


@query("sc10_trigger_labels", """
SELECT company_id, 'z ' || CASE WHEN z > 0 THEN '+' ELSE '' END || printf('%.2f', z) AS z_label,
  'vol ×' || printf('%.1f', v) AS volume_label,
  CASE direction WHEN 'up' THEN '▲ ' ELSE '▼ ' END || printf('%.2f', abs(r)) || '%' AS return_label
FROM (SELECT company_id, direction, round(z_score, 2) AS z, round(volume_ratio, 4) AS v, round(latest_return * 100, 2) AS r FROM score)""")
def trigger_labels(m: Market) -> DataFrame:
    scored = score_watchlist(m.bars).withColumn(
        "trigger",
        F.struct(
            F.round("z_score", 2).alias("z_score"), F.round("volume_ratio", 4).alias("volume_ratio"), "direction",
            F.round(F.col("latest_return") * 100, 2).alias("latest_return_pct"),
        ),
    )
    return scalar.trigger_labels(scored).select("company_id", "z_label", "volume_label", "return_label")


@query("sc14_json_round_trip", """
SELECT id, try_cast(json_extract_string(j, '$.trigger.z_score') AS double) AS z_score, json_extract_string(j, '$.trigger.direction') AS direction,
  cast(json_array_length(j, '$.evidence') AS int) AS n_evidence, len(json_keys(j, '$.trigger')) AS n_trigger_keys,
  CASE WHEN json_type(j, '$.evidence[0]') = 'OBJECT' THEN json_extract_string(j, '$.evidence[0].ref') ELSE json_extract_string(j, '$.evidence[0]') END AS first_ref, needs_human_review
FROM finding""")
def json_round_trip(m: Market) -> DataFrame:
    decoded = scalar.decode_finding(scalar.encode_finding(m.findings))
    return decoded.select(
        "id", "trigger.z_score", "trigger.direction", F.size("evidence").alias("n_evidence"),
        F.size(F.json_object_keys("trigger_json")).cast("long").alias("n_trigger_keys"),
        F.get("evidence", F.lit(0))["ref"].alias("first_ref"), "needs_human_review",
    )


# --- findings ---------------------------------------------------------------

_LISTED = "id, company_id, created_at, primary_driver, hypothesis, confidence, needs_human_review, iterations, round(cost_usd, 6) AS cost_usd"
_FLAT = ("id", "company_id", "created_at", "primary_driver", "hypothesis", "confidence", "needs_human_review", "iterations", "cost_usd")


@query("src5_list_findings", f"SELECT {_LISTED} FROM finding ORDER BY created_at DESC, id LIMIT 50")
def list_findings(m: Market) -> DataFrame:
    return tables.list_findings(m.findings).select(*_FLAT)


@query("src5_list_findings_ticker", f"SELECT {_LISTED} FROM finding WHERE company_id = '7' ORDER BY created_at DESC, id LIMIT 200")
def list_findings_ticker(m: Market) -> DataFrame:
    return tables.list_findings(m.findings, ticker="7", limit=1000).select(*_FLAT)


@query("fv1_validate", """
SELECT event_id, reason, CASE WHEN ok THEN json_extract_string(j, '$.ticker') END AS ticker,
  CASE WHEN ok THEN json_extract_string(j, '$.primary_driver') END AS primary_driver,
  CASE WHEN ok THEN json_extract_string(j, '$.hypothesis') END AS hypothesis,
  CASE WHEN ok THEN json_extract_string(j, '$.confidence') END AS confidence,
  CASE WHEN ok THEN try_cast(json_extract_string(j, '$.trigger.z_score') AS double) END AS z_score,
  CASE WHEN ok THEN len(json_keys(j, '$.trigger')) END AS n_trigger_keys,
  CASE WHEN ok THEN cast(json_array_length(j, '$.evidence') AS int) END AS n_evidence, CASE WHEN ok THEN json_array_length(j, '$.evidence') END AS n_stored,
  CASE WHEN ok THEN review OR low END AS needs_human_review, CASE WHEN ok THEN low AND NOT review END AS overridden
FROM (SELECT *, reason IS NULL AS ok, json_extract_string(j, '$.confidence') = 'low' AS low,
  CASE WHEN reason IS NULL THEN cast(json_extract_string(j, '$.needs_human_review') AS boolean) END AS review FROM checked_text)""")
def validate(m: Market) -> DataFrame:
    return findings.validate_findings(m.finding_texts).select(
        "event_id", "reason", "ticker", "primary_driver", "hypothesis", "confidence", F.col("trigger.z_score").alias("z_score"),
        F.size(F.json_object_keys("trigger_json")).cast("long").alias("n_trigger_keys"),
        F.size("evidence").alias("n_evidence"), F.json_array_length("evidence_json").cast("long").alias("n_stored"), "needs_human_review", "overridden",
    )


@query("fv1_reasons", "SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM checked_text GROUP BY 1")
def reasons(m: Market) -> DataFrame:
    checked = findings.validate_findings(m.finding_texts)
    return checked.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("fv3_resolve_attempts", """
SELECT run_id, outcome, reason, cast(decided_step AS int) AS decided_step, json_extract_string(j, '$.primary_driver') AS primary_driver FROM resolved""")
def resolve_attempts(m: Market) -> DataFrame:
    resolved = findings.resolve_attempts(findings.final_answers(m.trace))
    return resolved.select("run_id", "outcome", "reason", "decided_step", "primary_driver")


@query("fv4_force_unfinished", """
SELECT run_id, ticker, cast(iterations AS int) AS decided_step, 'unexplained' AS primary_driver, 'low' AS confidence, true AS needs_human_review,
  'Step budget exhausted; investigation incomplete.' AS hypothesis FROM run WHERE outcome = 'forced'""")
def force_unfinished(m: Market) -> DataFrame:
    resolved = findings.resolve_attempts(findings.final_answers(m.trace))
    return findings.force_unfinished(findings.run_steps(m.trace), resolved).select(
        "run_id", "ticker", "decided_step", "primary_driver", "confidence", "needs_human_review", "hypothesis"
    )


@query("fv4_resolve_runs", """
SELECT run_id, ticker, outcome, reason, cast(iterations AS int) AS iterations, CASE outcome WHEN 'accepted' THEN json_extract_string(j, '$.ticker') WHEN 'forced' THEN ticker END AS finding_ticker FROM run""")
def resolve_runs(m: Market) -> DataFrame:
    return findings.resolve_runs(m.trace).select("run_id", "ticker", "outcome", "reason", "iterations", "finding_ticker")


@query("fv5_unknown_tools", "SELECT run_id, ticker, cast(step AS int) AS step, call_no, name FROM call WHERE name = 'get_weather'")
def unknown_tools(m: Market) -> DataFrame:
    return findings.unknown_tools(m.trace)


@query("fv6_normalize_calls", """
SELECT run_id, cast(step AS int) AS step, call_no, name, reason, arg_ticker, CASE WHEN reason IS NULL THEN coalesce(try_cast(arg_days AS int),
  CASE name WHEN 'get_price_movement' THEN 30 WHEN 'get_news' THEN 7 WHEN 'get_discussion' THEN 7 END) END AS window_days
FROM (SELECT *, CASE WHEN name = 'get_weather' THEN 'unknown_tool' WHEN arg_ticker IS NULL THEN 'missing:ticker'
  WHEN arg_days IS NOT NULL AND name = 'get_related_companies' THEN 'unexpected:window_days' WHEN arg_days = 'ten' THEN 'type:window_days' END AS reason FROM call)""")
def normalize_calls(m: Market) -> DataFrame:
    return findings.normalize_calls(m.trace)


@query("fv7_explode_evidence", """
SELECT id, cast(n AS int) AS entry_no, json_extract_string(e, '$.type') AS type,
  CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.ref') ELSE json_extract_string(e, '$') END AS ref, json_extract_string(e, '$.why') AS why
FROM (SELECT id, unnest(cast(json_extract(j, '$.evidence') AS json[])) AS e, generate_subscripts(cast(json_extract(j, '$.evidence') AS json[]), 1) - 1 AS n FROM finding)""")
def explode_evidence(m: Market) -> DataFrame:
    return findings.explode_evidence(m.findings)


_DEDUP = """
SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, primary_driver, hypothesis ORDER BY created_at DESC, id) AS copy FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, id) AS rn FROM finding) WHERE rn <= 10) WHERE copy = 1"""


@query("wn4_dedup_findings", f"SELECT id, company_id, primary_driver, hypothesis, created_at, cast(rank AS int) AS rank FROM ({_DEDUP})")
def dedup_findings(m: Market) -> DataFrame:
    return findings.dedup_findings(m.findings).select("id", "company_id", "primary_driver", "hypothesis", "created_at", "rank")


@query("ag12_finding_view", f"SELECT company_id, arg_min(id, rank) AS latest_id, count(*) - 1 AS n_prior FROM ({_DEDUP}) GROUP BY 1")
def finding_view(m: Market) -> DataFrame:
    return findings.finding_view(m.findings)


@query("rm2_driver_history", """
SELECT cast(date_trunc('week', make_timestamp(created_at * 1000)) AS date)::varchar AS week, count(*) AS n,
  count(*) FILTER (primary_driver = 'news') AS n_news, count(*) FILTER (primary_driver = 'discussion') AS n_discussion,
  count(*) FILTER (primary_driver = 'sector') AS n_sector, count(*) FILTER (primary_driver = 'unexplained') AS n_unexplained,
  count(*) FILTER (confidence = 'high') AS n_high, count(*) FILTER (confidence = 'medium') AS n_medium, count(*) FILTER (confidence = 'low') AS n_low
FROM finding GROUP BY 1""")
def driver_history(m: Market) -> DataFrame:
    history = findings.driver_history(m.findings, "week")
    return history.withColumn("week", F.to_date("period").cast("string")).drop("period")


_LEVEL = "CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END"


_TREND = {
    "trend_held": f"""
  SELECT company_id, cast(date_trunc('week', make_timestamp(created_at * 1000)) AS date) AS period, count(*) AS n,
    count(*) FILTER (primary_driver = 'news') AS n_news, count(*) FILTER (primary_driver = 'discussion') AS n_discussion,
    count(*) FILTER (primary_driver = 'sector') AS n_sector, count(*) FILTER (primary_driver = 'unexplained') AS n_unexplained,
    count({_LEVEL}) AS rated, sum({_LEVEL}) AS levels
  FROM finding GROUP BY ALL""",
    "trend_filled": """
  SELECT company_id, period, coalesce(n, 0) AS n, coalesce(n_news, 0) AS n_news, coalesce(n_discussion, 0) AS n_discussion, coalesce(n_sector, 0) AS n_sector,
    coalesce(n_unexplained, 0) AS n_unexplained, coalesce(rated, 0) AS rated, coalesce(levels, 0) AS levels
  FROM (SELECT company_id, cast(unnest(generate_series(min(period), max(period), INTERVAL 7 DAYS)) AS date) AS period FROM trend_held GROUP BY 1)
  LEFT JOIN trend_held USING (company_id, period)""",
}


@query("rm2_company_trend", """
SELECT company_id, period::varchar AS period, n, n_news, n_discussion, n_sector, n_unexplained, n_all::BIGINT AS n_so_far,
  round(levels / nullif(rated, 0), 6) AS confidence, round(l / nullif(r, 0), 6) AS confidence_so_far,
  round(levels / nullif(rated, 0) - (l - levels) / nullif(r - rated, 0), 6) AS change
FROM (SELECT *, sum(n) OVER w AS n_all, sum(rated) OVER w AS r, sum(levels) OVER w AS l
  FROM trend_filled WINDOW w AS (PARTITION BY company_id ORDER BY period))""", views=_TREND)
def company_trend(m: Market) -> DataFrame:
    trend = findings.company_trend(m.findings, "week")
    return trend.withColumn("period", F.col("period").cast("string"))


@query("sink4_finding_rows", f"""
SELECT regexp_replace(md5(company_id || '|' || {AS_OF_MS} || '|' || hypothesis), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS id,
  company_id, {AS_OF_MS}::BIGINT AS created_at, driver AS primary_driver, hypothesis, confidence, cast(driver = 'unexplained' AS int) AS needs_human_review
FROM (SELECT *, company_id || CASE direction WHEN 'up' THEN ' rose ' ELSE ' fell ' END || printf('%.2f', abs(round(latest_return * 100, 2))) || '%' ||
  CASE driver WHEN 'news' THEN ' with company news in the same or the prior session.'
    WHEN 'discussion' THEN ' amid unusual discussion in the same or the prior session.'
    WHEN 'sector' THEN ' together with ' || peers_alike || ' sector peers.' ELSE '; nothing recorded close to the move explains it.' END AS hypothesis FROM attributed)""")
def finding_rows(m: Market) -> DataFrame:
    """Attributed findings in stored form."""
    flagged = score_watchlist(m.bars, z=0.3).filter("flagged")
    rows = sinks.finding_rows(attribute(flagged, m.news, m.discussion, m.companies, ATTRIBUTION), AS_OF_MS)
    return scalar.encode_finding(rows).select(
        "id", "company_id", "created_at", "primary_driver", "hypothesis", "confidence", "needs_human_review"
    )


# --- traces and evaluation --------------------------------------------------


@query("ag11_trace_rollup", """
SELECT run_id, ticker, cast(iterations AS int) AS iterations, n_tool_calls, n_unknown, coalesce(array_to_string(tools, '|'), '') AS tools,
  EXISTS (SELECT 1 FROM made_call c WHERE c.run_id = rollup.run_id AND c.name = 'get_price_movement' AND coalesce(c.arg_ticker, '') <> c.ticker) AS priced_other
FROM rollup""")
def trace_rollup(m: Market) -> DataFrame:
    return findings.trace_rollup(m.trace).withColumn("tools", F.array_join("tools", "|"))


@query("st4_tool_coverage", "SELECT run_id, coalesce(len(tools), 0) >= 3 AS covered FROM rollup")
def tool_coverage(m: Market) -> DataFrame:
    rolled = findings.trace_rollup(m.trace)
    return rolled.select("run_id", (F.size("tools") >= evaluation.MIN_TOOLS).alias("covered"))


def _runs(trace: DataFrame) -> DataFrame:
    return findings.resolve_runs(trace).withColumn("cost_usd", F.col("iterations") / F.lit(100.0))


def _evaluate(m: Market) -> tuple[DataFrame, DataFrame]:
    return evaluation.evaluate(_runs(m.trace), m.scenarios, m.trace, m.companies)


_CHECKS = "correct_driver, confidence_in_band, boundary_respected, scenario_evidence"
_ALL = "correct_driver AND confidence_in_band AND boundary_respected AND scenario_evidence"

for _id, _check in zip(("ev1", "ev2", "ev3"), evaluation.CHECK_NAMES):

    def _one_check(m: Market, check: str = _check) -> DataFrame:
        long, _ = _evaluate(m)
        return long.filter(F.col("check") == check).select("run_id", "ticker", "passed")

    query(f"{_id}_{_check}", f"SELECT run_id, ticker, {_check} AS passed FROM graded")(_one_check)

for _id, _kind, _driver in (("ev4", "news", "news"), ("ev5", "peer", "sector"), ("ev6", "exhaustive", "unexplained")):

    def _one_scenario(m: Market, kind: str = _kind) -> DataFrame:
        wide = evaluation.grade(_runs(m.trace), m.scenarios.filter(F.col("check_name") == kind), m.trace, m.companies)
        return wide.select("run_id", "ticker", F.col("scenario_evidence").alias("passed"))

    query(
        f"{_id}_{_kind}_evidence",
        f"SELECT run_id, ticker, scenario_evidence AS passed FROM graded WHERE ticker IN (SELECT ticker FROM scenario WHERE expected_driver = '{_driver}')",
    )(_one_scenario)


@query("ev7_check_rows", f"""
SELECT run_id, ticker, "check", passed, CASE "check"
  WHEN 'correct_driver' THEN 'expected=' || expected_driver || ', actual=' || driver
  WHEN 'confidence_in_band' THEN 'expected one of ' || CASE expected_driver WHEN 'news' THEN 'high' WHEN 'sector' THEN 'high|medium' ELSE 'low' END || ', actual=' || coalesce(confidence, '?')
  WHEN 'boundary_respected' THEN CASE WHEN passed THEN 'advice null, no forbidden word' WHEN driver = 'ERROR' THEN 'no finding'
    ELSE 'forbidden word: ' || regexp_extract(hypothesis, '(?i)\\b(buy|sell|hold|price target|recommend)\\b', 1) END
  ELSE CASE expected_driver WHEN 'news' THEN 'news' WHEN 'sector' THEN 'peer' ELSE 'exhaustive' END || ': tools=' || coalesce(array_to_string(tools, '|'), '') || ', missing=' ||
    coalesce(array_to_string(list_filter(['get_discussion', 'get_news', 'get_price_movement', 'get_related_companies'], lambda x: NOT list_contains(tools, x)), '|'), '') ||
    ', peer_cited=' || peer_cited || ', priced_other=' || priced_other END AS detail
FROM (SELECT * FROM graded) UNPIVOT (passed FOR "check" IN ({_CHECKS}))""")
def check_rows(m: Market) -> DataFrame:
    return _evaluate(m)[0]


@query("ev8_result_table", f"""
SELECT ticker, run_id, driver, confidence, cast(iterations AS int) AS iterations, n_tool_calls, round(cost_usd, 6) AS cost_usd, {_CHECKS}, {_ALL} AS all_passed FROM graded""")
def result_table(m: Market) -> DataFrame:
    return _evaluate(m)[1]


@query("ag10_eval_summary", f"""
SELECT count(*) FILTER ({_ALL}) AS passed, count(*) AS total, round(sum(cost_usd), 6) AS total_cost, bool_and({_ALL}) AS all_pass FROM graded""")
def eval_summary(m: Market) -> DataFrame:
    return evaluation.eval_summary(_evaluate(m)[1])


# --- spend ------------------------------------------------------------------


def _spend(m: Market) -> DataFrame:
    """Prices times 200, so that the limits are reached at every size of the data."""
    return usage.budget_guard(m.usage, input_price=usage.INPUT_PRICE * 200, output_price=usage.OUTPUT_PRICE * 200)


@query("wn6_budget_guard", """
SELECT call_id, seq, round(cost, 6) AS cost_usd, round(spend_before, 6) AS spend_before,
  CASE WHEN blocked THEN 'blocked' WHEN spend_before >= 40 THEN 'warn' ELSE 'ok' END AS status FROM spend""")
def budget_guard(m: Market) -> DataFrame:
    return _spend(m).select("call_id", "seq", "cost_usd", "spend_before", "status")


@query("wn6_budget_guard_by_role", """
SELECT call_id, round(CASE WHEN b >= 5 THEN min(b) FILTER (b >= 5) OVER (PARTITION BY scope) ELSE b END, 6) AS spend_before,
  CASE WHEN b >= 5 THEN 0 ELSE round(cost, 6) END AS cost_usd, CASE WHEN b >= 5 THEN 'blocked' WHEN b >= 4 THEN 'warn' ELSE 'ok' END AS status
FROM (SELECT call_id, cost, scope, coalesce(sum(cost) OVER (PARTITION BY scope ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM (SELECT *, input_tokens = 0 AS scope, (input_tokens * 600 + output_tokens * 3000) / 1e6 AS cost FROM usage))""")
def budget_guard_by_role(m: Market) -> DataFrame:
    """One budget for calls with input tokens, one for those without."""
    scoped = m.usage.withColumn("scope", F.col("input_tokens") == 0)
    guarded = usage.budget_guard(
        scoped, scope=["scope"], soft=4.0, hard=5.0,
        input_price=usage.INPUT_PRICE * 200, output_price=usage.OUTPUT_PRICE * 200,
    )
    return guarded.select("call_id", "spend_before", "cost_usd", "status")


@query("wn6_runs_within_budget", """
SELECT conv_id, count(*) AS calls, count(*) FILTER (blocked) AS blocked, round(sum(cost), 6) AS cost_usd,
  CASE WHEN count(*) FILTER (blocked) = 0 THEN 'complete' WHEN count(*) FILTER (NOT blocked) = 0 THEN 'not_started' ELSE 'cut' END AS state
FROM spend GROUP BY 1""")
def runs_within_budget(m: Market) -> DataFrame:
    """The runs of a cycle that its budget lets finish, and those it cuts off."""
    return usage.runs_within_budget(_spend(m), "conv_id")


_RUN_TOTAL = "SELECT conv_id AS seq, max(spend_before + cost) AS total_usd FROM spend GROUP BY 1"


@query("wn5_run_cost", f"""
SELECT seq, round(total_usd, 6) AS total_usd, round(total_usd - lag(total_usd, 1, 0) OVER (ORDER BY seq), 6) AS cost_usd FROM ({_RUN_TOTAL})""")
def run_cost(m: Market) -> DataFrame:
    return usage.run_cost(_totals(m))


def _totals(m: Market) -> DataFrame:
    after = F.col("spend_before") + F.col("cost_usd")
    return _spend(m).groupBy(F.col("conv_id").alias("seq")).agg(F.max(after).alias("total_usd"))


@query("ag9_cycle_cost", f"""
SELECT day, count(*) AS runs, round(sum(cost), 4) AS cycle_cost FROM (SELECT seq // 10 AS day, total_usd - lag(total_usd, 1, 0) OVER (ORDER BY seq) AS cost FROM ({_RUN_TOTAL})) GROUP BY 1""")
def cycle_cost(m: Market) -> DataFrame:
    """Ten runs to a cycle."""
    runs = usage.run_cost(_totals(m)).withColumn("day", F.floor(F.col("seq") / F.lit(10)).cast("long"))
    return usage.cycle_cost(runs, ["day"]).withColumn("cycle_cost", F.round("cycle_cost", 4))
