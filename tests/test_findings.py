import json

import pytest
from pyspark.sql import functions as F

from conftest import by_key, rows_of
from movewatch import schemas
from movewatch.functions import scalar
from movewatch.operators import findings as fd
from movewatch.sources.tables import list_findings

VALID = {
    "ticker": "NMBS",
    "trigger": {"z_score": -3.9, "volume_ratio": 3.1, "direction": "down", "latest_return_pct": -6.5},
    "hypothesis": "Guidance cut.",
    "primary_driver": "news",
    "evidence": [{"type": "news", "ref": "headline", "why": "same session"}],
    "confidence": "high",
    "needs_human_review": False,
    "advice": None,
}


def text(**changes):
    return json.dumps({k: v for k, v in {**VALID, **changes}.items() if v != "DROP"})


CASES = {
    "valid": (text(), None),
    "fence_json": ("```json\n" + text() + "\n```", None),
    "fence_bare": ("  ```\n" + text() + "\n```  \n", None),
    "prose": ("Here: " + text(), "not_json"),
    "truncated": (text()[:50], "not_json"),
    "empty": ("", "not_json"),
    "array": ("[" + text() + "]", "not_object"),
    "null": ("null", "not_object"),
    "number": ("7", "not_object"),
    **{f"missing_{f}": (text(**{f: "DROP"}), f"missing:{f}") for f, _ in fd.REQUIRED},
    "type_ticker": (text(ticker=7), "type:ticker"),
    "type_trigger": (text(trigger=[]), "type:trigger"),
    "null_hypothesis": (text(hypothesis=None), "type:hypothesis"),
    "type_driver": (text(primary_driver=["news"]), "type:primary_driver"),
    "type_evidence": (text(evidence={}), "type:evidence"),
    "type_confidence": (text(confidence=True), "type:confidence"),
    "review_number": (text(needs_human_review=1), "type:needs_human_review"),
    "review_text": (text(needs_human_review="true"), "type:needs_human_review"),
    "no_advice_key": (text(advice="DROP"), "missing:advice"),
    "advice_text": (text(advice="wait"), "advice_not_null"),
    "advice_false": (text(advice=False), "advice_not_null"),
    "bad_driver": (text(primary_driver="macro"), "value:primary_driver"),
    "bad_confidence": (text(confidence="certain"), "value:confidence"),
    "two_faults": (text(ticker=7, primary_driver="macro"), "type:ticker"),
    "driver_before_advice": (text(primary_driver="macro", advice="x"), "value:primary_driver"),
    "low_not_reviewed": (text(confidence="low"), None),
    "low_reviewed": (text(confidence="low", needs_human_review=True), None),
    "empty_objects": (text(trigger={}, evidence=[]), None),
    "unicode": (text(hypothesis="Führung gesenkt – ok"), None),
}


@pytest.fixture(scope="module")
def checked(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "id string, text string")
    return by_key(fd.validate_findings(df), "id")


@pytest.mark.parametrize("case", CASES)
def test_validation(checked, case):
    assert checked[case]["reason"] == CASES[case][1]
    assert (checked[case]["ticker"] is None) == (CASES[case][1] is not None)


def test_valid_fields(checked):
    row = checked["fence_json"]
    assert row["trigger"].asDict() == VALID["trigger"]
    assert [e.asDict() for e in row["evidence"]] == VALID["evidence"]
    assert (row["needs_human_review"], row["overridden"]) == (False, False)
    assert (checked["low_not_reviewed"]["needs_human_review"], checked["low_not_reviewed"]["overridden"]) == (True, True)
    assert (checked["low_reviewed"]["needs_human_review"], checked["low_reviewed"]["overridden"]) == (True, False)
    assert checked["empty_objects"]["evidence"] == []


def test_valid_and_rejected_partition_the_input(checked):
    assert len(checked) == len(CASES)


# --- runs -------------------------------------------------------------------

TOOL = [("get_news", {"ticker": "A"})]


def trace(spark, runs):
    """runs: run_id -> list of answers (text) or tool call lists, one per step."""
    rows = []
    for run, steps in runs.items():
        for i, step in enumerate(steps, 1):
            end = isinstance(step, str)
            rows.append((run, run.split("-")[0], i, "end" if end else "tool_use", step if end else None, None if end else step))
    return spark.createDataFrame(rows, schemas.TRACE)


def test_run_outcomes(spark):
    good, bad = text(), "oops"
    runs = {
        "A-accepted": [TOOL, good],
        "A-corrected": [bad, TOOL, good],
        "A-failed": [bad, TOOL, bad, good],  # the third answer is never asked for
        "A-open": [TOOL, bad],
        "A-forced": [TOOL] * 8,
        "A-forced_late": [TOOL] * 8 + [good],  # beyond the step budget
        "A-one_bad": [bad] + [TOOL] * 7,
        "A-last": [TOOL] * 7 + [good],
    }
    got = by_key(fd.resolve_runs(trace(spark, runs)), "run_id")
    assert {k: v["outcome"] for k, v in got.items()} == {
        "A-accepted": "accepted", "A-corrected": "accepted", "A-failed": "failed", "A-open": "open",
        "A-forced": "forced", "A-forced_late": "forced", "A-one_bad": "forced", "A-last": "accepted",
    }
    assert got["A-corrected"]["iterations"] == 3 and got["A-failed"]["iterations"] == 3
    assert got["A-failed"]["reason"] == "not_json"
    forced = got["A-forced"]
    assert (forced["primary_driver"], forced["confidence"], forced["needs_human_review"], forced["evidence"]) == ("unexplained", "low", True, [])
    assert forced["hypothesis"] == "Step budget exhausted; investigation incomplete."
    assert got["A-accepted"]["ticker"] == "A" and got["A-accepted"]["finding_ticker"] == "NMBS"


def test_forced_finding_takes_the_trigger(spark):
    triggers = spark.createDataFrame([("A", (1.0, 2.0, "up", 3.0))], f"company_id string, trigger struct<{schemas.TRIGGER.simpleString()[7:-1]}>")
    got = fd.resolve_runs(trace(spark, {"A-x": [TOOL] * 8}), triggers=triggers).first()
    assert got["trigger"]["direction"] == "up"


def test_tool_calls(spark):
    calls = [
        [("get_price_movement", {"ticker": "A"}), ("get_weather", {"ticker": "A"})],
        [("get_news", {"window_days": "14", "ticker": "A"}), ("get_discussion", {"ticker": "A", "window_days": "ten"})],
        [("get_related_companies", {"ticker": "A", "window_days": "3"}), ("get_related_companies", {"ticker": "A"}), ("get_news", {})],
    ]
    t = trace(spark, {"A-1": calls})
    got = [(r["step"], r["call_no"], r["reason"], r["window_days"]) for r in fd.normalize_calls(t).orderBy("step", "call_no").collect()]
    assert got == [
        (1, 0, None, 30), (1, 1, "unknown_tool", None), (2, 0, None, 14), (2, 1, "type:window_days", None),
        (3, 0, "unexpected:window_days", None), (3, 1, None, None), (3, 2, "missing:ticker", None),
    ]
    assert rows_of(fd.unknown_tools(t), "run_id", "step", "name") == [("A-1", 1, "get_weather")]
    rolled = fd.trace_rollup(t).first()
    assert (rolled["iterations"], rolled["n_tool_calls"], rolled["n_unknown"], rolled["priced_other"]) == (3, 7, 1, False)
    assert rolled["tools"] == sorted(schemas.TOOLS)


# --- stored findings --------------------------------------------------------


def stored(spark, rows):
    full = [(i, c, t, (1.0, 2.0, "up", 3.0), d, h, [("news", "r", "w")], "high", False, 1, 0.1) for i, c, t, d, h in rows]
    return spark.createDataFrame(full, schemas.FINDING)


def test_dedup_looks_at_the_newest_ten_only(spark):
    rows = [(f"f{i:02}", "A", i, "news", "old" if i < 2 else f"h{i % 3}") for i in range(12)]
    got = fd.dedup_findings(stored(spark, rows)).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in got] == [("f11", 1), ("f10", 2), ("f09", 3)]  # "old" fell out of the ten
    view = fd.finding_view(stored(spark, rows)).first()
    assert (view["latest_id"], view["n_prior"]) == ("f11", 2)


def test_list_findings(spark):
    df = stored(spark, [(f"f{i:03}", "AB" if i % 2 else "CD", i, "news", "h") for i in range(260)])
    assert list_findings(df).count() == 50
    assert list_findings(df, limit=10_000).count() == 200
    top = list_findings(df, ticker="ab", limit=2).collect()
    assert [r["id"] for r in top] == ["f259", "f257"]
    with pytest.raises(ValueError):
        list_findings(df, limit=0)


def test_json_round_trip_and_api_names(spark):
    df = stored(spark, [("f1", "A", 5, "news", "h")])
    coded = scalar.encode_finding(df)
    assert coded.first()["needs_human_review"] == 0
    assert scalar.decode_finding(coded).select(*df.columns).collect() == df.collect()
    assert scalar.to_api(df).columns == [
        "id", "companyId", "createdAt", "trigger", "primaryDriver", "hypothesis", "evidence", "confidence",
        "needsHumanReview", "iterations", "costUsd",
    ]


def test_history_and_evidence(spark):
    df = stored(spark, [("f1", "A", 5, "news", "h"), ("f2", "A", 6, "sector", "h")])
    got = fd.driver_history(df).first()
    assert (got["n"], got["n_news"], got["n_sector"], got["n_high"]) == (2, 1, 1, 2)
    assert rows_of(fd.explode_evidence(df), "id", "entry_no", "type") == [("f1", 0, "news"), ("f2", 0, "news")]


# --- text functions ---------------------------------------------------------


def test_advice_words(spark):
    cases = {
        "We recommend it": True, "She recommends it": False, "BUY now": True, "buyer": False, "a price target of 5": True,
        "Holders": False, "hold.": True, "éhold": False, "hold_on": False, "": False,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want boolean")
    assert df.filter(scalar.has_advice("t") != F.col("want")).count() == 0
    assert df.select(scalar.advice_hit("t")).first()[0] == "recommend"


def test_strip_fence(spark):
    cases = {"```json\n{}\n```": "{}", "```{}```": "{}", " x ": "x", "```json\n{}": "```json\n{}", "a ```{}```": "a ```{}```", "```\na\n\nb\n```": "a\n\nb"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert df.filter(scalar.strip_fence("t") != F.col("want")).count() == 0


def test_labels(spark):
    row = spark.createDataFrame([((2.5, 3.14, "up", 1.256),), ((-0.5, 1.0, "down", -2.0),), ((None, None, None, None),)], f"trigger {schemas.TRIGGER.simpleString()}")
    got = [tuple(r)[1:] for r in scalar.trigger_labels(row).collect()]
    assert got == [("z +2.50", "vol ×3.1", "▲ 1.26%"), ("z -0.50", "vol ×1.0", "▼ 2.00%"), (None, None, None)]
    numbers = spark.createDataFrame([(1.256,), (0.0,), (-3.0,), (None,)], "x double")
    assert [r[0] for r in numbers.select(scalar.pct_label("x")).collect()] == ["+1.26%", "+0.00%", "-3.00%", None]
    assert spark.createDataFrame([(1234567.5,)], "x double").select(scalar.price_label("x")).first()[0] == "1,234,567.50"


def test_ages_and_sizes(spark):
    hour = 3_600_000
    now = 1000 * hour
    ages = {0: "0m ago", 59 * 60_000: "59m ago", hour: "1h ago", 24 * hour - 1: "23h ago", 24 * hour: "1d ago", 50 * hour: "2d ago"}
    df = spark.createDataFrame([(now - a, w) for a, w in ages.items()], "t long, want string")
    assert df.filter(scalar.age_label("t", now) != F.col("want")).count() == 0
    sizes = {0: 20, 3 * hour: 20, 9 * hour: 19, 72 * hour: 8, 500 * hour: 8, -5 * hour: 20}  # 19.5 rounds up, 18.5 too
    df = spark.createDataFrame([(now - a, w) for a, w in sizes.items()], "t long, want long")
    assert df.filter(scalar.recency_size("t", now) != F.col("want")).count() == 0


def test_market_hours_and_iso(spark):
    cases = {
        "2024-01-08T14:29:59Z": False, "2024-01-08T14:30:00Z": True, "2024-01-08T21:00:00Z": True, "2024-01-08T21:00:00.001Z": False,
        "2024-01-06T16:00:00Z": False, "2024-07-08T13:30:00Z": True, "2024-07-08T13:29:59Z": False, "2024-07-08T20:00:01Z": False,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want boolean")
    assert df.filter(scalar.is_market_hours(F.col("t").cast("timestamp")) != F.col("want")).count() == 0
    iso = {"2024-01-01T00:00:07.179Z": 1704067207179, "2024-01-01T05:30:07+05:30": 1704067207000, "2024-01-01": 1704067200000, "2024": None, "soon": None, "2024-13-01T00:00:00Z": None,
           "2024-01-01T10:00Z": 1704103200000, "20240101T100000Z": 1704103200000, "2024-01-01T10": 1704103200000, "20240101": 1704067200000,
           "2024-01-01T1000+01:00": 1704099600000, "2024-01-01T10:00:00.5+0230": 1704094200500, "2024-0101": None, "2024-01-01T25:00Z": None}
    df = spark.createDataFrame([(k, v) for k, v in iso.items()], "t string, want long")
    assert df.filter(~scalar.iso_to_ms("t").eqNullSafe(F.col("want"))).count() == 0
    assert spark.range(1).select(scalar.ms_to_s(F.lit(-1))).first()[0] == -1


def test_nothing_of_a_valid_text_is_lost(spark):
    body = {
        "ticker": "A", "trigger": {"z_score": "high", "note": {"k": 1}, "direction": "up"}, "hypothesis": "h", "primary_driver": "news",
        "evidence": ["Reuters headline", {"type": "news", "ref": "r", "why": "w", "seen": True}, 7], "confidence": "high",
        "needs_human_review": False, "advice": None,
    }
    row = fd.validate_findings(spark.createDataFrame([(json.dumps(body),)], "text string")).first()
    assert row["reason"] is None and row["trigger"]["z_score"] is None and row["trigger"]["direction"] == "up"
    assert json.loads(row["trigger_json"]) == body["trigger"] and json.loads(row["evidence_json"]) == body["evidence"]
    assert [tuple(e) for e in row["evidence"]] == [(None, "Reuters headline", None), ("news", "r", "w"), (None, "7", None)]
    df = fd.validate_findings(spark.createDataFrame([(json.dumps(body),)], "text string"))
    back = scalar.decode_finding(scalar.encode_finding(df)).first()
    assert back["evidence"] == row["evidence"] and json.loads(back["trigger_json"]) == body["trigger"]
