"""Spend of model calls: cost per call, budget guard, cost per run and per cycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewatch.operators.joins import lookup
from movewatch.operators.ordered import lag_by_bucket, prefix_sums, time_bucket

# --- fixed values: USD per million tokens, and spend limits in USD ----------
INPUT_PRICE = 3.0
OUTPUT_PRICE = 15.0
SOFT_WARN = 40.0
HARD_CAP = 50.0
# ----------------------------------------------------------------------------

# Order values to a bucket: calls are numbered in steps of a run, runs one by one.
CALL_BUCKET = 10_000_000
RUN_BUCKET = 10_000

_MONEY = "decimal(28,8)"


def call_cost(input_price: float = INPUT_PRICE, output_price: float = OUTPUT_PRICE) -> Column:
    """Cost of a call in USD as an exact decimal, so sums do not depend on their order."""
    tokens = F.col("input_tokens") * F.lit(input_price) + F.col("output_tokens") * F.lit(output_price)
    return F.round(tokens / F.lit(1e6), 8).cast(_MONEY)


def budget_guard(
    usage: DataFrame,
    order: str = "seq",
    tie: str = "call_id",
    scope: Sequence[str] = (),
    soft: float = SOFT_WARN,
    hard: float = HARD_CAP,
    input_price: float = INPUT_PRICE,
    output_price: float = OUTPUT_PRICE,
    bucket: int = CALL_BUCKET,
) -> DataFrame:
    """Adds cost_usd, spend_before and status (ok, warn, blocked) to every call.

    The check comes before the call, so one call may overshoot. Once spend reaches ``hard``
    every later call is blocked: it is never made and costs nothing, and its
    ``spend_before`` is the total of the calls that were made.

    The order is one sequence per scope, cut into buckets of ``bucket`` order values; totals
    per bucket are summed once and carried into running sums inside the buckets.
    """
    costed = usage.withColumn("_cost", call_cost(input_price, output_price))
    summed = prefix_sums(costed, scope, [order, tie], time_bucket(order, bucket), {"_before": F.col("_cost")})
    # Costs are not negative, so the smallest sum at or above the limit is what was spent in all.
    over = F.col("_before") >= F.lit(hard)
    totals = summed.groupBy(*scope).agg(F.min(F.when(over, F.col("_before"))).alias("_spent"))
    if scope:
        keys = {f"_k{i}": F.struct(c) for i, c in enumerate(scope)}  # a NULL scope is a scope, too
        joined = lookup(summed.withColumns(keys), totals.withColumns(keys).drop(*scope), list(keys), tie, "left").drop(*keys)
    else:
        joined = summed.withColumn("_spent", totals.scalar())
    status = F.when(over, "blocked").when(F.col("_before") >= F.lit(soft), "warn").otherwise("ok")
    return joined.withColumns({
        "status": status,
        "cost_usd": F.when(over, F.lit(0.0)).otherwise(F.col("_cost").cast("double")),
        "spend_before": F.when(over, F.col("_spent")).otherwise(F.col("_before")).cast("double"),
    }).drop("_cost", "_before", "_spent")


def runs_within_budget(guarded: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs of a cycle against its budget: complete, cut (stopped at a blocked call) or not_started.

    The first blocked call ends the cycle. Only complete runs give findings; cut ones keep
    what they cost.
    """
    calls, blocked = F.count(F.lit(1)), F.count_if(F.col("status") == "blocked")
    state = F.when(F.col("blocked") == 0, "complete").when(F.col("blocked") < F.col("calls"), "cut").otherwise("not_started")
    rolled = guarded.groupBy(run).agg(calls.alias("calls"), blocked.alias("blocked"), F.sum("cost_usd").alias("cost_usd"))
    return rolled.withColumn("state", state)


def run_cost(spend_log: DataFrame, order: str = "seq", bucket: int = RUN_BUCKET) -> DataFrame:
    """Cost of each run from the cumulative spend after it: total minus the total before.

    ``spend_log`` has (seq, total_usd), seq unique. As the total never falls, the total
    before a run is the last one of the bucket before when the run opens its bucket.
    """
    lagged = lag_by_bucket(spend_log, [], order, "total_usd", time_bucket(order, bucket), "_prev")
    before = F.coalesce("_prev", F.lit(0.0))
    return lagged.withColumn("cost_usd", F.round(F.col("total_usd") - before, 6)).drop("_prev")


def cycle_cost(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of run costs, failed runs included."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cycle_cost")
    )
