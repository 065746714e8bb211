"""Table schemas and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
MS_PER_DAY = 86_400_000
DRIVERS = ("news", "discussion", "sector", "unexplained")
CONFIDENCES = ("high", "medium", "low")
RANGE_DAYS = {"1D": 1, "1W": 7, "1M": 30, "3M": 90}
TOOLS = ("get_price_movement", "get_news", "get_discussion", "get_related_companies")
TOOL_WINDOW_DAYS = {"get_price_movement": 30, "get_news": 7, "get_discussion": 7}
SEED_COMPANIES = (
    ("AAPL", "Apple", "Technology"),
    ("MSFT", "Microsoft", "Technology"),
    ("GOOGL", "Alphabet", "Technology"),
    ("AMZN", "Amazon", "Consumer"),
    ("NVDA", "Nvidia", "Semiconductors"),
)
DEMO_COMPANIES = (
    ("NMBS", "Nimbus Software", "Software"),
    ("ORCH", "Orchid Biosciences", "Biotech"),
    ("HLIX", "Helix Therapeutics", "Biotech"),
    ("VRTA", "Vertica Biotech", "Biotech"),
    ("DRFT", "Drift Dynamics", "Logistics"),
)
# ----------------------------------------------------------------------------


def _struct(*fields: tuple) -> T.StructType:
    out = T.StructType()
    for name, dtype, *nullable in fields:
        out.add(name, dtype, nullable[0] if nullable else True)
    return out


_S, _L, _D, _B, _I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()

COMPANY = _struct(("company_id", _S, False), ("name", _S, False), ("sector", _S))
BAR = _struct(
    ("company_id", _S, False), ("ts_ms", _L, False),
    ("open", _D), ("high", _D), ("low", _D), ("close", _D), ("volume", _L),
)
NEWS = _struct(
    ("id", _S, False), ("company_id", _S, False), ("headline", _S, False),
    ("summary", _S), ("source", _S), ("url", _S), ("published_at", _L),
)
DISCUSSION = _struct(
    ("id", _S, False), ("company_id", _S, False), ("title", _S, False),
    ("summary", _S), ("source", _S), ("url", _S), ("published_at", _L),
)
TRIGGER = _struct(
    ("z_score", _D), ("volume_ratio", _D), ("direction", _S), ("latest_return_pct", _D),
)
EVIDENCE = T.ArrayType(_struct(("type", _S), ("ref", _S), ("why", _S)))
FINDING = _struct(
    ("id", _S, False), ("company_id", _S, False), ("created_at", _L, False),
    ("trigger", TRIGGER, False), ("primary_driver", _S, False), ("hypothesis", _S, False),
    ("evidence", EVIDENCE, False), ("confidence", _S, False),
    ("needs_human_review", _B, False), ("iterations", _L, False), ("cost_usd", _D, False),
)
# A finding as stored: nested fields as JSON text, the boolean as 0/1.
STORED_FINDING = _struct(
    ("id", _S), ("company_id", _S), ("created_at", _L), ("primary_driver", _S), ("hypothesis", _S),
    ("confidence", _S), ("needs_human_review", _I), ("iterations", _L), ("cost_usd", _D),
    ("trigger_json", _S), ("evidence_json", _S),
)
USAGE = _struct(
    ("call_ts", T.TimestampType()), ("input_tokens", _L), ("output_tokens", _L), ("cost_usd", _D),
)
TOOL_CALLS = T.ArrayType(_struct(("name", _S), ("args", T.MapType(_S, _S))))
TRACE = _struct(
    ("run_id", _S, False), ("ticker", _S, False), ("step", _I, False),
    ("stop_reason", _S), ("text", _S), ("tool_calls", TOOL_CALLS),
)
SCENARIO = _struct(
    ("ticker", _S, False), ("expected_driver", _S), ("expected_band", T.ArrayType(_S)),
    ("expected_review", _B), ("check_name", _S),
)
