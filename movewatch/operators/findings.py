"""Findings: validation of raw text, run resolution, display rules, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from movewatch.functions.scalar import evidence_entries, once, strip_fence
from movewatch.operators.ordered import prefix_sums, top_n
from movewatch.schemas import CONFIDENCES, DRIVERS, EVIDENCE, TOOL_WINDOW_DAYS, TOOLS, TRIGGER

# --- fixed values: required fields in checking order, and run limits ---------
REQUIRED = (
    ("ticker", "STRING"),
    ("trigger", "OBJECT"),
    ("hypothesis", "STRING"),
    ("primary_driver", "STRING"),
    ("evidence", "ARRAY"),
    ("confidence", "STRING"),
    ("needs_human_review", "BOOLEAN"),
)
MAX_STEPS = 8
MAX_ANSWERS = 2
FORCED_HYPOTHESIS = "Step budget exhausted; investigation incomplete."
# ----------------------------------------------------------------------------


#: The fields of a text, each left as it is: one look at the text gives them all.
_FIELDS = "struct<" + ",".join(f"{name}:variant" for name in [*(n for n, _ in REQUIRED), "advice"]) + ">"


def _part(name: str) -> Column:
    return F.col(f"_f.{name}")


def _text(name: str) -> Column:
    return F.try_variant_get(_part(name), "$", "string")


def _rejection() -> Column:
    """First broken rule as a code, NULL for a valid text."""
    checks = [
        F.when(F.col("_v").isNull(), "not_json"),
        F.when(F.col("_f").isNull(), "not_object"),
    ]
    for name, kind in REQUIRED:
        part = _part(name)
        checks.append(F.when(part.isNull(), f"missing:{name}"))
        checks.append(F.when(~F.schema_of_variant(part).startswith(kind), f"type:{name}"))
    checks += [
        F.when(_part("advice").isNull(), "missing:advice"),
        F.when(~_text("primary_driver").isin(*DRIVERS), "value:primary_driver"),
        F.when(~_text("confidence").isin(*CONFIDENCES), "value:confidence"),
        F.when(~F.is_variant_null(_part("advice")), "advice_not_null"),
    ]
    return F.coalesce(*checks)


def validate_findings(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``reason`` (NULL when valid) and the finding's fields to raw texts.

    Rules are checked in a fixed order and the first broken one is the reason: JSON, object,
    the seven fields (each present, then typed), ``advice`` present, driver value, confidence
    value, advice null. Low confidence forces review; ``overridden`` records that it did.
    Duplicate keys and NaN count as invalid JSON. ``trigger_json`` and ``evidence_json`` are all that was
    given; the typed columns beside them hold what has the usual shape.
    """
    checked = once(df, _v=F.try_parse_json(strip_fence(text_col)))
    checked = once(checked, _f=F.try_variant_get("_v", "$", _FIELDS))
    checked = once(checked, reason=_rejection())
    valid = F.col("reason").isNull()
    review = F.try_variant_get(_part("needs_human_review"), "$", "boolean")
    low = _text("confidence") == "low"
    keep = {
        "ticker": _text("ticker"),
        "trigger_json": F.to_json(_part("trigger")),
        "evidence_json": F.to_json(_part("evidence")),
        "trigger": F.from_json(F.to_json(_part("trigger")), TRIGGER),
        "hypothesis": _text("hypothesis"),
        "primary_driver": _text("primary_driver"),
        "evidence": evidence_entries(_part("evidence")),
        "confidence": _text("confidence"),
        "needs_human_review": review | low,
        "overridden": low & ~review,
    }
    names = [c for c in df.columns if c not in keep and c != "reason"]
    return checked.select(*names, "reason", *[F.when(valid, v).alias(k) for k, v in keep.items()])


FINDING_FIELDS = (
    "ticker", "trigger", "hypothesis", "primary_driver", "evidence",
    "confidence", "needs_human_review", "overridden", "trigger_json", "evidence_json",
)


def final_answers(trace: DataFrame, max_steps: int = MAX_STEPS, limit: int = MAX_ANSWERS) -> DataFrame:
    """The first ``limit`` final answers of each run within the step budget."""
    ends = trace.filter((F.col("stop_reason") == "end") & (F.col("step") <= max_steps))
    return top_n(
        ends.select("run_id", "step", F.coalesce("text", F.lit("")).alias("text")),
        ["run_id"], [F.asc("step")], limit, "attempt",
    )


def resolve_attempts(attempts: DataFrame, limit: int = MAX_ANSWERS) -> DataFrame:
    """One row per run with an answer: the first valid one, or the last reason.

    ``outcome`` is accepted, failed (``limit`` rejected answers) or open (one rejected).
    """
    checked = validate_findings(attempts)
    valid = F.col("reason").isNull()
    found = F.struct("attempt", "step", *FINDING_FIELDS)
    runs = checked.groupBy("run_id").agg(
        F.min_by(F.when(valid, found), F.when(valid, F.col("attempt"))).alias("f"),
        F.count(F.lit(1)).alias("answers"),
        F.max_by("reason", "attempt").alias("last_reason"),
        F.max("step").alias("_last_step"),
    )
    outcome = (
        F.when(F.col("f").isNotNull(), "accepted")
        .when(F.col("answers") >= limit, "failed")
        .otherwise("open")
    )
    return runs.select(
        "run_id",
        outcome.alias("outcome"),
        F.when(F.col("f").isNull(), F.col("last_reason")).alias("reason"),
        F.coalesce("f.step", "_last_step").alias("decided_step"),
        *[F.col(f"f.{c}").alias(c) for c in FINDING_FIELDS],
    )


def run_steps(trace: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Steps used per run, within the budget."""
    return trace.filter(F.col("step") <= max_steps).groupBy("run_id", "ticker").agg(
        F.max("step").alias("steps")
    )


def force_unfinished(
    steps: DataFrame, resolved: DataFrame, max_steps: int = MAX_STEPS, triggers: DataFrame | None = None
) -> DataFrame:
    """The fixed finding of every run that spent its steps without being decided.

    ``triggers`` (company_id, trigger) supplies the trigger the run was started with.
    """
    decided = resolved.filter(F.col("outcome").isin("accepted", "failed")).select("run_id")
    spent = steps.filter(F.col("steps") >= max_steps).join(decided, "run_id", "left_anti")
    if triggers is None:
        spent = spent.withColumn("trigger", F.lit(None).cast(TRIGGER))
    else:
        by_ticker = triggers.select(F.col("company_id").alias("ticker"), "trigger")
        spent = spent.join(by_ticker, "ticker", "left")
    return spent.select(
        "run_id",
        F.lit("forced").alias("outcome"),
        F.lit(None).cast("string").alias("reason"),
        F.col("steps").alias("decided_step"),
        "ticker",
        "trigger",
        F.lit(FORCED_HYPOTHESIS).alias("hypothesis"),
        F.lit("unexplained").alias("primary_driver"),
        F.array().cast(EVIDENCE).alias("evidence"),
        F.lit("low").alias("confidence"),
        F.lit(True).alias("needs_human_review"),
        F.lit(False).alias("overridden"),
        F.to_json("trigger").alias("trigger_json"),
        F.lit("[]").alias("evidence_json"),
    )


def resolve_runs(trace: DataFrame, max_steps: int = MAX_STEPS, triggers: DataFrame | None = None) -> DataFrame:
    """Every run with its outcome: accepted, failed, forced or open.

    ``ticker`` is the company under investigation, ``finding_ticker`` the one the finding
    names; a finding is stored under the latter.
    """
    resolved = resolve_attempts(final_answers(trace, max_steps))
    steps = run_steps(trace, max_steps)
    forced = force_unfinished(steps, resolved, max_steps, triggers)
    decided = (
        resolved.filter(F.col("outcome") != "open")
        .unionByName(forced)
        .withColumnRenamed("ticker", "finding_ticker")
    )
    return (
        steps.join(decided, "run_id", "left")
        .withColumn("outcome", F.coalesce("outcome", F.lit("open")))
        .withColumn("iterations", F.coalesce("decided_step", "steps"))
        .drop("decided_step", "steps")
    )


# --- tool calls -------------------------------------------------------------

def tool_calls(trace: DataFrame, max_steps: int | None = None) -> DataFrame:
    """One row per tool call, in (step, call_no) order within a run; of all steps unless told otherwise."""
    steps = trace if max_steps is None else trace.filter(F.col("step") <= max_steps)
    return steps.select(
        "run_id", "ticker", "step", F.posexplode("tool_calls").alias("call_no", "call")
    ).select("run_id", "ticker", "step", "call_no", F.col("call.name").alias("name"), F.col("call.args").alias("args"))


def unknown_tools(trace: DataFrame, catalog: Sequence[str] = TOOLS, max_steps: int | None = None) -> DataFrame:
    """Calls of tools that are not in the catalogue."""
    return tool_calls(trace, max_steps).filter(~F.col("name").isin(*catalog)).drop("args")


def normalize_calls(trace: DataFrame, max_steps: int | None = None) -> DataFrame:
    """Tool calls with typed arguments and defaults, or the reason they are refused."""
    window = F.col("args")["window_days"]
    days = window.try_cast("int")
    default = F.lit(None).cast("int")
    for tool, value in TOOL_WINDOW_DAYS.items():
        default = F.when(F.col("name") == tool, F.lit(value)).otherwise(default)
    takes_window = F.col("name").isin(*TOOL_WINDOW_DAYS)
    reason = (
        F.when(~F.col("name").isin(*TOOLS), "unknown_tool")
        .when(F.col("args")["ticker"].isNull(), "missing:ticker")
        .when(window.isNotNull() & ~takes_window, "unexpected:window_days")
        .when(window.isNotNull() & days.isNull(), "type:window_days")
    )
    return (
        tool_calls(trace, max_steps)
        .withColumn("reason", reason)
        .select(
            "run_id", "step", "call_no", "name", "reason",
            F.col("args")["ticker"].alias("arg_ticker"),
            F.when(F.col("reason").isNull(), F.coalesce(days, default)).alias("window_days"),
        )
    )


def trace_rollup(trace: DataFrame, catalog: Sequence[str] = TOOLS, max_steps: int = MAX_STEPS) -> DataFrame:
    """Per run: iterations, number of tool calls, catalogue tools used, unknown calls, and
    whether another ticker than the run's own was priced.

    The calls themselves, in order, are ``tool_calls``; nothing is collected per run.
    """
    calls = F.coalesce("tool_calls", F.array().cast(trace.schema["tool_calls"].dataType))
    known = F.array(*[F.lit(t) for t in catalog])
    names = F.transform("_calls", lambda c: c["name"])
    flags = [F.bool_or(F.array_contains(names, t)).alias(f"_t{i}") for i, t in enumerate(catalog)]
    other = F.exists(
        "_calls",
        lambda c: (c["name"] == "get_price_movement")
        & (F.upper(F.coalesce(c["args"]["ticker"], F.lit(""))) != F.upper("ticker")),
    )
    rolled = (
        trace.filter(F.col("step") <= max_steps)
        .select("run_id", "ticker", "step", calls.alias("_calls"))
        .groupBy("run_id", "ticker")
        .agg(
            F.max("step").alias("iterations"),
            F.sum(F.size("_calls")).alias("n_tool_calls"),
            F.sum(F.size(F.filter("_calls", lambda c: ~F.array_contains(known, c["name"])))).alias("n_unknown"),
            F.bool_or(other).alias("priced_other"),
            *flags,
        )
    )
    used = F.array_compact(F.array(*[F.when(F.col(f"_t{i}"), F.lit(t)) for i, t in enumerate(catalog)]))
    return rolled.select(
        "run_id", "ticker", "iterations", "n_tool_calls", "n_unknown", F.array_sort(used).alias("tools"), "priced_other"
    )


# --- stored findings --------------------------------------------------------

def explode_evidence(findings: DataFrame, key: str = "id") -> DataFrame:
    """One row per evidence entry, with its place in the list."""
    return findings.select(key, F.posexplode("evidence").alias("entry_no", "e")).select(
        key, "entry_no", "e.type", "e.ref", "e.why"
    )


def dedup_findings(findings: DataFrame, pre_limit: int = 10) -> DataFrame:
    """Newest finding per (driver, hypothesis) among each company's newest ``pre_limit``.

    Rank 1 is the latest finding, the rest are prior ones. Both windows after the first
    cut work on at most ``pre_limit`` rows per company.
    """
    newest = [F.desc("created_at"), F.asc("id")]
    recent = top_n(findings, ["company_id"], newest, pre_limit)
    same = Window.partitionBy("company_id", "primary_driver", "hypothesis").orderBy(*newest)
    first = recent.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("company_id").orderBy(*newest)))


def finding_view(findings: DataFrame, pre_limit: int = 10) -> DataFrame:
    """Per company: its latest finding and the number of prior ones."""
    return dedup_findings(findings, pre_limit).groupBy("company_id").agg(
        F.min_by("id", "rank").alias("latest_id"), (F.count(F.lit(1)) - 1).alias("n_prior")
    )


def driver_history(findings: DataFrame, unit: str = "week") -> DataFrame:
    """Findings per period with the number per driver and per confidence."""
    period = F.date_trunc(unit, F.timestamp_millis("created_at")).alias("period")
    drivers = [F.count_if(F.col("primary_driver") == d).alias(f"n_{d}") for d in DRIVERS]
    levels = [F.count_if(F.col("confidence") == c).alias(f"n_{c}") for c in CONFIDENCES]
    return findings.groupBy(period).agg(F.count(F.lit(1)).alias("n"), *drivers, *levels)


def company_trend(findings: DataFrame, unit: str = "week") -> DataFrame:
    """Findings of each company per period, with its confidence so far: a row for every period from its first to its last one.

    ``confidence`` is the mean level of the period's findings (low 1, medium 2, high 3), NULL in a period without any;
    ``confidence_so_far`` that of all findings up to the period's end, ``change`` the period's mean less the mean before it.
    Findings are combined per company and period before anything is ordered, and the running sums are carried from
    year to year, so a company with most of the findings costs one row a period.
    """
    steps = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}
    level = F.array_position(F.array(*[F.lit(c) for c in ("low", "medium", "high")]), F.col("confidence"))
    known = F.when(level > 0, level)
    period = F.date_trunc(unit, F.timestamp_millis("created_at")).cast("date")
    drivers = [F.count_if(F.col("primary_driver") == d).alias(f"n_{d}") for d in DRIVERS]
    held = findings.filter(F.col("company_id").isNotNull() & F.col("created_at").isNotNull()).groupBy("company_id", period.alias("period")).agg(
        F.count(F.lit(1)).alias("n"), *drivers, F.count(known).alias("_rated"), F.sum(known).alias("_levels")
    )
    ends = held.groupBy("company_id").agg(F.min("period").alias("_from"), F.max("period").alias("_to"))
    every = ends.select("company_id", F.explode(F.sequence("_from", "_to", F.expr(f"interval {steps[unit]}"))).alias("period"))
    counted = ["n", *[f"n_{d}" for d in DRIVERS], "_rated", "_levels"]
    filled = every.join(held, ["company_id", "period"], "left").fillna(0, counted)
    running = prefix_sums(filled, ["company_id"], ["period"], F.year("period"), {"_n": F.col("n"), "_r": F.col("_rated"), "_l": F.col("_levels")})

    def mean(total: Column, count: Column) -> Column:
        return total / F.nullif(count, F.lit(0))
    now, before = mean(F.col("_levels"), F.col("_rated")), mean(F.col("_l"), F.col("_r"))
    return running.select(
        "company_id", "period", "n", *[f"n_{d}" for d in DRIVERS], (F.col("_n") + F.col("n")).alias("n_so_far"),
        now.alias("confidence"), mean(F.col("_l") + F.col("_levels"), F.col("_r") + F.col("_rated")).alias("confidence_so_far"), (now - before).alias("change"),
    )
