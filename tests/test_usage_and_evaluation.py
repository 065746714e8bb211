import json

import pytest
from pyspark.sql import functions as F

from conftest import by_key, rows_of
from movewatch import schemas
from movewatch.operators import evaluation, findings, usage


def test_budget_limits(spark):
    # one output token costs 15 USD / 1e6, so tokens give the spend before each call exactly
    costs = [39.99, 0.01, 9.99, 0.01, 7.0, 1.0]
    rows = [(i, f"c{i}", 0, round(c / 15e-6 * 3)) for i, c in enumerate(costs)]
    calls = spark.createDataFrame(rows, "seq long, call_id string, input_tokens long, output_tokens long")
    guarded = usage.budget_guard(calls, output_price=5.0)
    got = [(round(r["spend_before"], 6), r["status"], round(r["cost_usd"], 6)) for r in guarded.orderBy("seq").collect()]
    # a blocked call is never made: it costs nothing and raises nothing
    assert got == [
        (0.0, "ok", 39.99), (39.99, "ok", 0.01), (40.0, "warn", 9.99), (49.99, "warn", 0.01), (50.0, "blocked", 0.0), (50.0, "blocked", 0.0),
    ]


def test_runs_a_budget_cuts_off(spark):
    rows = [(i, f"c{i}", 0, 1_000_000, f"r{i // 2}") for i in range(8)]  # 15 USD a call
    calls = spark.createDataFrame(rows, "seq long, call_id string, input_tokens long, output_tokens long, run_id string")
    states = rows_of(usage.runs_within_budget(usage.budget_guard(calls, bucket=3)), "run_id", "state", "cost_usd")
    assert states == [("r0", "complete", 30.0), ("r1", "complete", 30.0), ("r2", "not_started", 0.0), ("r3", "not_started", 0.0)]
    guarded = usage.budget_guard(calls, hard=40.0)
    assert rows_of(usage.runs_within_budget(guarded), "run_id", "state")[1] == ("r1", "cut")
    assert guarded.agg(F.sum("cost_usd")).first()[0] == 45.0


def test_scopes_have_their_own_budget(spark):
    rows = [(i, f"c{i}", 1_000_000, 0, "x" if i % 3 else "y") for i in range(30)]
    calls = spark.createDataFrame(rows, "seq long, call_id string, input_tokens long, output_tokens long, scope string")
    guarded = usage.budget_guard(calls, scope=["scope"], bucket=4)
    assert rows_of(guarded.groupBy("scope").agg(F.max("spend_before").alias("m")), "scope", "m") == [("x", 51.0), ("y", 27.0)]


def test_run_cost_and_cycle(spark):
    log = spark.createDataFrame([(i, round(0.1 * i * i, 4)) for i in range(1, 50)], "seq long, total_usd double")
    got = [r["cost_usd"] for r in usage.run_cost(log, bucket=8).orderBy("seq").collect()]
    assert got == [pytest.approx(0.1 * (2 * i - 1)) for i in range(1, 50)]
    total = usage.cycle_cost(usage.run_cost(log)).first()
    assert total["runs"] == 49 and total["cycle_cost"] == pytest.approx(240.1)


# --- the rubric on the three known scenarios --------------------------------

SCENARIOS = [
    ("AAA", "news", ["high"], False, "news"),
    ("BB1", "sector", ["medium", "high"], False, "peer"),
    ("CCC", "unexplained", ["low"], True, "exhaustive"),
    ("QUI", "news", ["high"], False, "news"),  # never run
]


def call(name, ticker, **args):
    return (name, {"ticker": ticker, **args})


def answer(ticker, driver, confidence, evidence, hypothesis="It moved.", review=False):
    return json.dumps({
        "ticker": ticker, "trigger": {"z_score": -3.0}, "hypothesis": hypothesis, "primary_driver": driver,
        "evidence": evidence, "confidence": confidence, "needs_human_review": review, "advice": None,
    })


GOOD = {
    "AAA": ([[call("get_price_movement", "AAA")], [call("get_news", "AAA")]],
            answer("AAA", "news", "high", [{"type": "news", "ref": "cut", "why": "same day"}])),
    "BB1": ([[call("get_news", "BB1")], [call("get_related_companies", "BB1")], [call("get_price_movement", "bb2"), call("get_price_movement", "BB3")]],
            answer("BB1", "sector", "medium", [{"type": "sector", "ref": "peers", "why": "fell with bb2 holdings inc."}])),
    "CCC": ([[call("get_price_movement", "CCC")], [call("get_news", "CCC")], [call("get_discussion", "CCC")]],
            answer("CCC", "unexplained", "low", [], review=True)),
}


def grade(spark, companies, runs, **options):
    rows = []
    for ticker, (calls, text) in runs.items():
        steps = [(ticker, ticker, i, "tool_use", None, c) for i, c in enumerate(calls, 1)]
        rows += steps + [(ticker, ticker, len(steps) + 1, "end", text, None)]
    trace = spark.createDataFrame(rows, schemas.TRACE)
    scenarios = spark.createDataFrame(SCENARIOS, schemas.SCENARIO)
    resolved = findings.resolve_runs(trace).withColumn("cost_usd", F.lit(0.05))
    return evaluation.evaluate(resolved, scenarios, trace, companies, **options)


def test_good_runs_pass(spark, companies):
    long, wide = grade(spark, companies, GOOD, with_review=True)
    got = by_key(wide, "ticker")
    for ticker in GOOD:
        assert got[ticker]["all_passed"], ticker
    assert (got["BB1"]["iterations"], got["BB1"]["n_tool_calls"]) == (4, 4)
    missing = got["QUI"]
    assert missing["driver"] == "ERROR" and not any(missing[c] for c in evaluation.CHECK_NAMES)
    assert evaluation.eval_summary(wide).first().asDict() == {"passed": 3, "total": 4, "total_cost": pytest.approx(0.15), "all_pass": False}
    assert long.count() == 16 and long.filter("detail IS NULL").count() == 0


def verdict(spark, companies, ticker, calls=None, **changes):
    base_calls, text = GOOD[ticker]
    body = {**json.loads(text), **changes}
    _, wide = grade(spark, companies, {ticker: (base_calls if calls is None else calls, json.dumps(body))})
    row = by_key(wide, "ticker")[ticker]
    return [c for c in evaluation.CHECK_NAMES if not row[c]]


def test_each_check_can_fail(spark, companies):
    def v(ticker, calls=None, **changes):
        return verdict(spark, companies, ticker, calls, **changes)

    assert v("AAA", primary_driver="sector") == ["correct_driver"]
    assert v("AAA", confidence="medium") == ["confidence_in_band"]
    assert v("AAA", hypothesis="Investors should SELL") == ["boundary_respected"]
    assert v("AAA", evidence=[{"type": "price", "ref": "x", "why": "y"}]) == ["scenario_evidence"]
    assert v("AAA", calls=[[call("get_price_movement", "AAA")]]) == ["scenario_evidence"]
    assert v("BB1", evidence=[{"type": "sector", "ref": "BB1", "why": "itself; CCC too"}]) == ["scenario_evidence"]
    assert v("BB1", evidence=[{"type": "sector", "ref": "BB3", "why": ""}]) == []
    assert v("BB1", calls=[[call("get_related_companies", "BB1")], [call("get_price_movement", "bb1")]]) == ["scenario_evidence"]
    assert v("BB1", calls=[[call("get_price_movement", "BB2")]]) == ["scenario_evidence"]
    assert v("CCC", evidence=[{"type": "price", "ref": "CCC", "why": "large"}]) == []
    assert v("CCC", evidence=[{"type": "sector", "ref": "x", "why": "y"}]) == ["scenario_evidence"]
    assert v("CCC", calls=[[call("get_news", "CCC")], [call("get_news", "CCC")], [call("get_weather", "CCC")]]) == ["scenario_evidence"]


def test_names_tied_to_other_words_are_found(spark):
    companies = spark.createDataFrame(
        [("ME", "Me Inc", "S"), ("HLIX", "Helix Therapeutics", "S"), ("BRK.B", "Smith-Jones Corp", "S")], schemas.COMPANY
    )
    said = {
        "HLIX's sell-off": True, "an HLIX-led move": True, "pre-HLIX": True, "Helix Therapeutics's fall": True, "BRK.B's day": True,
        "Smith-Jones Corp's": True, "helixes": False, "HLIXX": False, "Helix fell": False, "me inc": False,
    }
    rows = [(text, "ME", [("sector", text, "w")]) for text in said]
    runs = spark.createDataFrame(rows, "run_id string, ticker string, evidence array<struct<type:string,ref:string,why:string>>")
    assert {r["run_id"] for r in evaluation.cited_peers(runs, companies).collect()} == {t for t, hit in said.items() if hit}


def test_shared_names_do_not_multiply(spark):
    rows = [(f"c{i}", "Same Name", "S") for i in range(300)]
    companies = spark.createDataFrame([*rows, ("solo", "Solo", "T")], schemas.COMPANY)
    runs = spark.createDataFrame(
        [("r1", "c7", [("sector", "SAME  name", "x")]), ("r2", "solo", [("sector", "solo", "x")]), ("r3", "c8", [("sector", "none", "c9.")])],
        "run_id string, ticker string, evidence array<struct<type:string,ref:string,why:string>>",
    )
    assert rows_of(evaluation.cited_peers(runs, companies), "run_id") == [("r1",), ("r3",)]
