"""The four-check rubric over runs x scenarios x traces.

``runs`` has one row per investigation: run_id, ticker, primary_driver, confidence,
hypothesis, evidence, and optionally advice, needs_human_review and cost_usd. A run that
errored has NULL finding fields and fails every check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewatch.functions.scalar import ADVICE_WORDS, advice_hit, has_advice
from movewatch.operators.findings import trace_rollup
from movewatch.operators.joins import lookup
from movewatch.schemas import TOOLS

# --- fixed values -----------------------------------------------------------
POSITIVE_EVIDENCE = ("news", "discussion", "sector")
MIN_TOOLS = 3
CHECK_NAMES = ("correct_driver", "confidence_in_band", "boundary_respected", "scenario_evidence")
# ----------------------------------------------------------------------------

# A word for name matching: letters and digits, with inner marks as in "BRK.B".
_WORD = r"[\p{L}\p{N}#&]+(?:[.'\-][\p{L}\p{N}#&]+)*"


_PART = r"[\p{L}\p{N}#&]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def readings(text: Column) -> Column:
    """The ways to cut a text into words: with inner marks, without a possessive ending, and at every mark.

    So a name is found by itself and where a mark ties it to another word, as in "BRK.B's" or "pre-HLIX".
    """
    whole = words(text)
    bare = F.transform(whole, lambda w: F.regexp_replace(w, r"'s$", ""))
    parts = F.regexp_extract_all(F.lower(text), F.lit(_PART), F.lit(0))
    return F.array_distinct(F.array(whole, bare, parts))


def _phrases(tokens: Column, longest: Column) -> Column:
    """All runs of 1..longest consecutive tokens, joined by one space."""
    size = F.size(tokens)
    by_length = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(longest, size))),
        lambda n: F.transform(
            F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " ")
        ),
    )
    return F.when(size > 0, F.array_distinct(F.flatten(by_length)))


def cited_peers(runs: DataFrame, companies: DataFrame, key: str = "run_id") -> DataFrame:
    """Keys of the runs whose evidence names a same-sector peer by id or name, in any case.

    Evidence phrases are matched to company names with an equi-join on (sector, phrase), so
    a sector's members are looked up and never paired with its runs. Phrases are as long as
    the longest name of the sector, so no name is out of reach.
    """
    listed = companies.filter(F.col("sector").isNotNull()).select("company_id", "sector", "name")
    names = listed.select("company_id", "sector", F.array_join(words(F.col("name")), " ").alias("phrase"))
    ids = listed.select("company_id", "sector", F.array_join(words(F.col("company_id")), " ").alias("phrase"))
    # Many companies may share a name: the first and the last id tell whether any is a peer.
    lexicon = names.unionByName(ids).filter(F.col("phrase") != "").groupBy("sector", "phrase").agg(
        F.min("company_id").alias("first_id"), F.max("company_id").alias("last_id")
    )
    longest = lexicon.groupBy("sector").agg(F.max(F.size(F.split("phrase", " "))).alias("longest"))
    cited = runs.select(key, "ticker", F.explode("evidence").alias("e")).select(
        key, "ticker", F.explode(readings(F.concat_ws(" ", "e.type", "e.ref", "e.why"))).alias("tokens")
    )
    sectors = listed.select(F.col("company_id").alias("ticker"), "sector")
    entries = lookup(lookup(cited, sectors, ["ticker"], key), longest, ["sector"], key)
    said = entries.select(key, "ticker", "sector", F.explode(_phrases(F.col("tokens"), F.col("longest"))).alias("phrase")).distinct()
    return (
        lookup(said, lexicon, ["sector", "phrase"], key)
        .filter((F.col("first_id") != F.col("ticker")) | (F.col("last_id") != F.col("ticker")))
        .select(key)
        .distinct()
    )


def has_evidence(kind: str) -> Column:
    return F.exists("evidence", lambda e: e["type"] == kind)


def news_check() -> Column:
    """Cites news and called get_news."""
    return has_evidence("news") & F.array_contains("tools", "get_news")


def peer_check() -> Column:
    """Names a peer, asked for the peers and priced at least one other ticker."""
    return F.col("peer_cited") & F.array_contains("tools", "get_related_companies") & F.col("priced_other")


def exhaustive_check() -> Column:
    """Cites no positive cause after using at least three of the four tools."""
    none = F.forall("evidence", lambda e: ~F.coalesce(e["type"].isin(*POSITIVE_EVIDENCE), F.lit(False)))
    known = F.array(*[F.lit(t) for t in TOOLS])
    return none & (F.size(F.array_intersect("tools", known)) >= MIN_TOOLS)


# Scenario checks by the name a scenario gives; add to this to extend the rubric.
SCENARIO_CHECKS = {"news": news_check, "peer": peer_check, "exhaustive": exhaustive_check}


def grade(
    runs: DataFrame,
    scenarios: DataFrame,
    traces: DataFrame,
    companies: DataFrame,
    advice_words: tuple[str, ...] = ADVICE_WORDS,
    with_review: bool = False,
) -> DataFrame:
    """One row per scenario and run of its ticker, one boolean per check, and all_passed.

    ``with_review`` adds a check of expected_review, which the rubric itself does not make.
    """
    if "advice" not in runs.columns:
        runs = runs.withColumn("advice", F.lit(None).cast("string"))
    if "cost_usd" not in runs.columns:
        runs = runs.withColumn("cost_usd", F.lit(0.0))
    # iterations and tool calls are those of the trace
    chosen = lookup(runs.drop("iterations"), scenarios, ["ticker"], "run_id")
    idle = scenarios.join(runs.select("ticker").distinct(), "ticker", "left_anti")
    rollup = trace_rollup(traces).drop("ticker")
    cited = cited_peers(chosen.filter(F.col("evidence").isNotNull()), companies).withColumn("peer_cited", F.lit(True))
    facts = (
        chosen.unionByName(idle, allowMissingColumns=True)
        .join(rollup, "run_id", "left")
        .join(cited, "run_id", "left")
        .fillna(False, ["priced_other", "peer_cited"])
        .withColumn("tools", F.coalesce("tools", F.array().cast("array<string>")))
    )
    by_name = F.lit(None).cast("boolean")
    for name, check in SCENARIO_CHECKS.items():
        by_name = F.when(F.col("check_name") == name, check()).otherwise(by_name)
    checks = {
        "correct_driver": F.col("primary_driver") == F.col("expected_driver"),
        "confidence_in_band": F.array_contains("expected_band", F.col("confidence")),
        "boundary_respected": F.col("advice").isNull() & ~has_advice("hypothesis", advice_words),
        "scenario_evidence": by_name,
    }
    if with_review:
        checks["review_as_expected"] = F.col("needs_human_review") == F.col("expected_review")
    errored = F.col("primary_driver").isNull()
    marks = {k: F.when(errored, False).otherwise(F.coalesce(v, F.lit(False))) for k, v in checks.items()}
    graded = facts.withColumns(marks)
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.col(name)
    return graded.select(
        "ticker", "run_id",
        F.when(errored, "ERROR").otherwise(F.col("primary_driver")).alias("driver"),
        "confidence", "iterations", "n_tool_calls",
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        *checks, passed.alias("all_passed"),
        "expected_driver", "expected_band", F.col("check_name"), "tools", "peer_cited", "priced_other",
        F.coalesce(advice_hit("hypothesis", advice_words), F.lit("")).alias("advice_word"),
    )


def evaluate(
    runs: DataFrame, scenarios: DataFrame, traces: DataFrame, companies: DataFrame, **options
) -> tuple[DataFrame, DataFrame]:
    """(long, wide): one row per check with its detail, and one row per graded run."""
    wide = grade(runs, scenarios, traces, companies, **options)
    return check_rows(wide), wide.drop(
        "expected_driver", "expected_band", "check_name", "tools", "peer_cited", "priced_other", "advice_word"
    )


def check_rows(wide: DataFrame) -> DataFrame:
    """Graded runs in long form: check, passed, detail."""
    expected = F.concat(F.lit("expected="), F.col("expected_driver"), F.lit(", actual="), F.col("driver"))
    band = F.concat(
        F.lit("expected one of "), F.array_join(F.array_sort("expected_band"), "|"),
        F.lit(", actual="), F.coalesce("confidence", F.lit("?")),
    )
    boundary = (
        F.when(F.col("boundary_respected"), "advice null, no forbidden word")
        .when(F.col("advice_word") != "", F.concat(F.lit("forbidden word: "), F.col("advice_word")))
        .when(F.col("driver") == "ERROR", "no finding")
        .otherwise("advice given")
    )
    called = F.array(*[F.lit(t) for t in TOOLS])
    facts = F.concat(
        F.col("check_name"), F.lit(": tools="), F.array_join("tools", "|"),
        F.lit(", missing="), F.array_join(F.array_sort(F.array_except(called, "tools")), "|"),
        F.lit(", peer_cited="), F.col("peer_cited").cast("string"),
        F.lit(", priced_other="), F.col("priced_other").cast("string"),
    )
    details = dict(zip(CHECK_NAMES, (expected, band, boundary, facts)))
    rows = F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(name).alias("passed"), text.alias("detail"))
        for name, text in details.items()
    ])
    return wide.select("ticker", "run_id", F.explode(rows).alias("c")).select("ticker", "run_id", "c.*")


def eval_summary(wide: DataFrame) -> DataFrame:
    """One row: scenarios passed, total, total cost, and whether all passed."""
    return wide.agg(
        F.count_if("all_passed").alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.bool_and("all_passed"), F.lit(True)).alias("all_pass"),
    )
