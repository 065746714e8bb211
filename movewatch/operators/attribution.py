"""Why a company moved: news, discussion, sector or unexplained.

The written investigation rules as one job over all flagged companies. The rules give
words; the numbers below are this library's reading of them:

* session: calendar day of the anchor bar in ``zone``; the prior session is the weekday before;
* causal window: from the start of the prior session to the end of the anomaly session;
* unusual discussion: at least one post in the causal window, and posts per session there
  (count / 2) at least ``surge`` times posts per day (count / 7) over the 7 days before the
  anchor up to the end of the session;
* moved alike: a peer flagged in the same direction on the same session.

Order of causes: news (at least ``min_news`` items), discussion, sector (at least ``min_peers`` peers), unexplained.
News outside the causal window counts as none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewatch.functions.scalar import ms_to_ts
from movewatch.operators.anomaly import with_trigger
from movewatch.operators.joins import lookup
from movewatch.operators.ordered import top_n
from movewatch.operators.retrieval import since
from movewatch.schemas import EVIDENCE, MS_PER_DAY


@dataclass(frozen=True)
class AttributionParams:
    zone: str = "UTC"
    surge: float = 2.0
    min_peers: int = 2
    min_news: int = 1
    baseline_days: int = 7
    max_evidence: int = 3  # newest items, or strongest peers, shown with a finding; evidence_items has all


def prior_weekday(day: Column) -> Column:
    """The weekday before a date: Friday for Sunday and Monday."""
    back = F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1)
    return F.date_sub(day, back)


def with_session(scores: DataFrame, zone: str = "UTC") -> DataFrame:
    """Adds the session day and the causal window [window_from, window_to) in ms."""
    local_day = F.to_date(F.from_utc_timestamp(ms_to_ts("anchor_ms"), zone))

    def midnight(day: Column) -> Column:
        return F.unix_millis(F.to_utc_timestamp(day.cast("timestamp"), zone))

    return (
        scores.withColumn("session_day", local_day)
        .withColumn("window_from", midnight(prior_weekday(F.col("session_day"))))
        .withColumn("window_to", midnight(F.date_add("session_day", 1)))
    )


def _moves(flagged: DataFrame, companies: DataFrame, p: AttributionParams) -> DataFrame:
    baseline = F.col("anchor_ms") - F.lit(MS_PER_DAY * p.baseline_days)
    return (
        with_session(flagged, p.zone)
        .join(companies.select("company_id", "name", "sector"), "company_id", "left")
        .withColumn("recent_from", baseline)
    )


def _in_window(news: DataFrame, discussion: DataFrame, moves: DataFrame) -> DataFrame:
    """News and posts of flagged companies up to the end of the session, marked causal or not.

    The earliest date any move asks for is a filter at the scan of both tables, so of a long
    history only its end is read and shuffled. Both go through one join.
    """
    spans = moves.select("company_id", "window_from", "window_to", "recent_from")
    earliest = spans.agg(F.min(F.least("recent_from", "window_from"))).scalar()
    latest = spans.agg(F.max("window_to")).scalar()

    def shape(items: DataFrame, kind: str, text: str) -> DataFrame:
        wanted = since(items, earliest).filter(F.col("published_at") < latest)
        return wanted.select("company_id", "id", "published_at", F.col(text).alias("text"), F.lit(kind).alias("kind"))

    both = shape(news, "news", "headline").unionByName(shape(discussion, "discussion", "title"))
    return (
        lookup(both, spans, ["company_id"], "id")
        .filter(F.col("published_at") < F.col("window_to"))
        .filter(F.col("published_at") >= F.least("recent_from", "window_from"))
        .withColumn("causal", F.col("published_at") >= F.col("window_from"))
        .withColumn("recent", F.col("published_at") >= F.col("recent_from"))
    )


def _counts(window: DataFrame) -> DataFrame:
    def n(kind: str, mark: str) -> Column:
        return F.count_if((F.col("kind") == kind) & F.col(mark))
    return window.groupBy("company_id").agg(
        n("news", "causal").alias("news_causal"), n("discussion", "causal").alias("posts_causal"), n("discussion", "recent").alias("posts_recent")
    )


def _newest(window: DataFrame, k: int) -> DataFrame:
    """The k newest causal items of each company and kind as small arrays."""
    order = [F.desc("published_at"), F.asc("id")]
    best = top_n(window.filter("causal"), ["company_id", "kind"], order, k, "rank")

    def refs(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", F.col("text").alias("ref")))))
    return best.groupBy("company_id").agg(refs("news").alias("news_refs"), refs("discussion").alias("post_refs"))


_GROUP = ("sector", "direction", "session_day")


def _peers_alike(moves: DataFrame, k: int) -> DataFrame:
    """Per (sector, direction, session): how many other companies moved alike, and the strongest of them."""
    placed = moves.filter(F.col("sector").isNotNull())
    movers = placed.groupBy(*_GROUP).agg((F.count(F.lit(1)) - 1).alias("peers_alike"))
    # one more than needed, since a company is not its own peer
    strongest = top_n(
        placed.select(*_GROUP, "company_id", "name", "z_score"), _GROUP,
        [F.desc(F.abs("z_score")), F.asc("company_id")], k + 1, "rank",
    )
    leaders = strongest.groupBy(*_GROUP).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("company_id").alias("ref"), "name"))).alias("leaders")
    )
    return movers.join(leaders, [*_GROUP])


def _driver(p: AttributionParams) -> Column:
    crowd = (F.col("posts_causal") >= 1) & (
        F.col("posts_causal") / F.lit(2.0)
        >= F.lit(p.surge) * F.col("posts_recent") / F.lit(float(p.baseline_days))
    )
    return (
        F.when(F.col("news_causal") >= p.min_news, "news")
        .when(crowd, "discussion")
        .when(F.col("peers_alike") >= p.min_peers, "sector")
        .otherwise("unexplained")
    )


def attribute(
    flagged: DataFrame,
    news: DataFrame,
    discussion: DataFrame,
    companies: DataFrame,
    params: AttributionParams = AttributionParams(),
) -> DataFrame:
    """One finding per flagged company.

    ``flagged`` are rows of ``score_watchlist``. Items join to moves on the company, with
    one move per company, so a company with very many items is a split of its own join
    side and never multiplies; counts are combined before they are shuffled. Peers are
    counted per (sector, direction, session), not paired. ``evidence`` shows the newest or
    strongest few; ``evidence_items`` lists all.
    """
    p = params
    moves = _moves(flagged, companies, p)
    items = _in_window(news, discussion, moves)
    counted = moves.join(_counts(items), "company_id", "left").join(_newest(items, p.max_evidence), "company_id", "left")
    joined = lookup(counted, _peers_alike(moves, p.max_evidence), [*_GROUP], "company_id", "left").fillna(
        0, ["news_causal", "posts_causal", "posts_recent", "peers_alike"]
    )
    out = with_trigger(joined).withColumn("primary_driver", _driver(p))
    return _conclude(out, p).select(
        "company_id", "anchor_ms", "session_day", "trigger", "hypothesis", "primary_driver", "evidence",
        "confidence", "needs_human_review", "news_causal", "posts_causal", "peers_alike",
    )


def evidence_items(
    flagged: DataFrame,
    news: DataFrame,
    discussion: DataFrame,
    companies: DataFrame,
    params: AttributionParams = AttributionParams(),
) -> DataFrame:
    """All evidence for the findings of ``attribute``, in long form: company_id, type, item_id, ref, published_at.

    For a move with news or discussion as driver these are all its causal items. A sector move's peers
    are as many rows as its group has members; they are given once a group, by
    ``sector_members``, since listing them per company would be quadratic.
    """
    moves = _moves(flagged, companies, params)
    found = attribute(flagged, news, discussion, companies, params).select("company_id", "primary_driver")
    causal = _in_window(news, discussion, moves).filter("causal")
    return lookup(causal, found, ["company_id"], "id").filter(F.col("kind") == F.col("primary_driver")).select(
        "company_id", F.col("kind").alias("type"), F.col("id").alias("item_id"), F.col("text").alias("ref"), "published_at"
    )


def sector_members(flagged: DataFrame, companies: DataFrame, params: AttributionParams = AttributionParams()) -> DataFrame:
    """Every flagged company with the group it moved with: sector, direction, session_day, z_score, peers_alike."""
    moves = _moves(flagged, companies, params).filter(F.col("sector").isNotNull())
    counts = moves.groupBy(*_GROUP).agg((F.count(F.lit(1)) - 1).alias("peers_alike"))
    return lookup(moves.select(*_GROUP, "company_id", "name", "z_score"), counts, [*_GROUP], "company_id")


def confidence_for(driver: Column) -> Column:
    return (
        F.when(driver == "news", "high")
        .when(driver.isin("sector", "discussion"), "medium")
        .otherwise("low")
    )


def _evidence(refs: str, kind: str, why: Column) -> Column:
    return F.transform(
        F.col(refs), lambda r: F.struct(F.lit(kind).alias("type"), r["ref"].alias("ref"), why.alias("why"))
    )


def _conclude(df: DataFrame, p: AttributionParams) -> DataFrame:
    driver = F.col("primary_driver")
    moved = F.concat(
        F.col("company_id"),
        F.when(F.col("direction") == "up", " rose ").otherwise(" fell "),
        F.format_string("%.2f%%", F.abs(F.col("trigger.latest_return_pct"))),
    )
    because = (
        F.when(driver == "news", " with company news in the same or the prior session.")
        .when(driver == "discussion", " amid unusual discussion in the same or the prior session.")
        .when(driver == "sector", F.concat(F.lit(" together with "), F.col("peers_alike").cast("string"), F.lit(" sector peers.")))
        .otherwise("; nothing recorded close to the move explains it.")
    )
    me = F.col("company_id")
    peers = F.slice(F.filter("leaders", lambda x: x["ref"] != me), 1, p.max_evidence)
    day = F.col("session_day").cast("string")
    same_day = F.concat(F.lit("moved the same way on "), day)
    published = F.concat(F.lit("published in the session of "), day, F.lit(" or the one before"))
    evidence = (
        F.when(driver == "news", _evidence("news_refs", "news", published))
        .when(driver == "discussion", _evidence("post_refs", "discussion", published))
        .when(driver == "sector", _evidence("_peers", "sector", same_day))
        .otherwise(F.array().cast(EVIDENCE))
    )
    confidence = confidence_for(driver)
    return (
        df.withColumn("_peers", peers)
        .withColumn("hypothesis", F.concat(moved, because))
        .withColumn("evidence", evidence)
        .withColumn("confidence", confidence)
        .withColumn("needs_human_review", confidence == "low")
    )
