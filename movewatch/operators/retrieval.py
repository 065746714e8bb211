"""Signals around a move: peers, anchored windows, markers, latest items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from movewatch.functions.scalar import blank_nulls, ms_to_s
from movewatch.operators.joins import SALTS, lookup
from movewatch.operators.ordered import positions, top_n
from movewatch.schemas import MS_PER_DAY

MARKER_TOLERANCE_S = 172_800


# --- companies --------------------------------------------------------------

def known_companies(requested: DataFrame, companies: DataFrame) -> DataFrame:
    """Requested tickers (upper-cased) with whether they are companies."""
    asked = requested.select(F.upper("ticker").alias("company_id")).distinct()
    known = companies.select("company_id").distinct().withColumn("known", F.lit(True))
    return asked.join(known, "company_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))



def peer_groups(companies: DataFrame, null_safe: bool = False) -> DataFrame:
    """Every company with its sector and its number of peers.

    The peer relation of all companies in linear size: the peers of a company are the
    other members of its sector. A company without sector has no peers, or, with
    ``null_safe``, those that have none either.
    """
    # A missing sector gets a key of its own, as NULL does not join.
    key = F.concat(F.col("sector").isNull().cast("string"), F.coalesce("sector", F.lit("")))
    keyed = companies.withColumn("_key", key)
    counts = keyed.groupBy("_key").agg((F.count(F.lit(1)) - 1).alias("_n"))
    joined = lookup(keyed, counts, ["_key"], "company_id")
    n = F.col("_n") if null_safe else F.when(F.col("sector").isNotNull(), F.col("_n")).otherwise(0)
    return joined.select("company_id", "name", "sector", n.alias("n_peers"))


def peers(companies: DataFrame, requested: DataFrame, null_safe: bool = False) -> DataFrame:
    """The same-sector peers of each requested company, itself excluded.

    ``requested`` has a company_id column. The answer lists every peer, so its size is
    that of the sectors asked for: ask for the companies under investigation, and use
    ``peer_groups`` to describe all of them at once.
    """
    asked = requested.select("company_id").distinct()
    mine = companies.join(asked, "company_id", "left_semi").alias("a")
    match = F.col("a.sector").eqNullSafe(F.col("b.sector")) if null_safe else F.col("a.sector") == F.col("b.sector")
    # a sector's members are dealt to parts, the few requested companies copied to each of them
    parts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    mine = mine.select("a.*", F.explode(parts).alias("_salt")).alias("a")
    others = companies.withColumn("_salt", F.pmod(F.xxhash64("company_id"), F.lit(SALTS)).cast("int")).alias("b")
    match = match & (F.col("a._salt") == F.col("b._salt"))
    return mine.join(others, match & (F.col("a.company_id") != F.col("b.company_id"))).select(
        F.col("a.company_id"),
        F.col("b.company_id").alias("peer_id"),
        F.col("b.name").alias("peer_name"),
        F.col("b.sector").alias("sector"),
    )


def ordered_peers(companies: DataFrame, requested: DataFrame, null_safe: bool = True) -> DataFrame:
    """``peers`` with a 0-based position for each company.

    Any fixed order will do; md5 order is used because its first byte cuts a sector of
    any size into 256 even buckets.
    """
    listed = peers(companies, requested, null_safe).withColumn("_h", F.md5("peer_id"))
    bucket = F.conv(F.substring("_h", 1, 2), 16, 10).cast("int")
    return positions(listed, ["company_id"], ["_h", "peer_id"], bucket).drop("_h")


# --- signals ----------------------------------------------------------------

def unified_signals(news: DataFrame, discussion: DataFrame) -> DataFrame:
    """News and discussion in one shape; a post's title is its headline."""
    def shape(df: DataFrame, kind: str, text: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("type"), "id", F.col(text).alias("headline"),
            "summary", "source", "url", "company_id", "published_at",
        )
    return shape(news, "news", "headline").unionByName(shape(discussion, "discussion", "title"))


def since(items: DataFrame, earliest: Column) -> DataFrame:
    """Items published at or after a time, in ms; of a stored table only the day folders from then on."""
    found = items.filter(F.col("published_at") >= earliest)
    if "day" in items.columns:
        found = found.filter(F.col("day") >= F.to_date(F.timestamp_millis(earliest)))
    return found


def _since_anchor(items: DataFrame, anchor: DataFrame, days: int) -> DataFrame:
    """Items from ``days`` before their company's anchor on. The earliest such time filters the scan."""
    start = F.col("anchor_ms") - F.lit(days * MS_PER_DAY)
    items = since(items, anchor.agg(F.min(start)).scalar())
    found = lookup(items, anchor.select("company_id", "anchor_ms"), ["company_id"], "id")
    return found.filter(F.col("published_at") >= start)


def news_window(news: DataFrame, anchor: DataFrame, days: int = 7) -> DataFrame:
    """News from ``days`` days before the anchor on; there is no upper bound."""
    return _since_anchor(news, anchor, days).select(
        "company_id", "id", "headline", "summary", "source", "published_at"
    )


def discussion_window(discussion: DataFrame, anchor: DataFrame, days: int = 7) -> DataFrame:
    """Posts from ``days`` days before the anchor on, title as body."""
    return _since_anchor(discussion, anchor, days).select(
        "company_id", "id", F.col("title").alias("body"), "source", "published_at"
    )


def newest_first(items: DataFrame) -> DataFrame:
    """Display order: company, then newest, NULL times last, id for ties."""
    return items.orderBy("company_id", F.desc_nulls_last("published_at"), "id")


def latest_signals(items: DataFrame, k: int = 10) -> DataFrame:
    """The k newest items per company with rank 1..k, optional texts blanked."""
    ranked = top_n(items, ["company_id"], [F.desc_nulls_last("published_at"), F.asc("id")], k, "rank")
    return blank_nulls(ranked)


def company_signals(companies: DataFrame, news: DataFrame, discussion: DataFrame, k: int = 10) -> DataFrame:
    """Every company's k newest news and k newest posts in one shape."""
    signals = unified_signals(news, discussion)
    ranked = top_n(signals, ["company_id", "type"], [F.desc_nulls_last("published_at"), F.asc("id")], k, "rank")
    return companies.join(blank_nulls(ranked), "company_id")


def event_markers(news: DataFrame, discussion: DataFrame, bounds: DataFrame) -> DataFrame:
    """Signals inside a company's first..last bar, both included, time in seconds.

    Display order is (time, type_rank, id): news before discussion at the same time.
    """
    def shape(df: DataFrame, kind: str, rank: int) -> DataFrame:
        return df.select("company_id", "id", "published_at", F.lit(kind).alias("type"), F.lit(rank).alias("type_rank"))
    both = shape(news, "news", 0).unionByName(shape(discussion, "discussion", 1))
    return (
        lookup(both, bounds, ["company_id"], "id")
        .filter(F.col("published_at").between(F.col("from_ms"), F.col("to_ms")))
        .select("company_id", ms_to_s("published_at").alias("time"), F.col("id").alias("signal_id"), "type", "type_rank")
    )


def nearest_signal(points: DataFrame, markers: DataFrame, tol_s: int = MARKER_TOLERANCE_S) -> DataFrame:
    """The marker nearest to each (company_id, time) point, less than tol_s away.

    At equal distance the earlier marker wins, then news before discussion, then the id.

    Time is cut into buckets as wide as the tolerance. A point's match is then in its own
    bucket, or is the last marker of the bucket before or the first of the one after; so
    each bucket gets those two along with its own rows, and a running window in each
    direction finds the neighbours. Rows stay linear in points + markers: no candidate pairs
    are formed. Both sides hold distinct seconds, so a bucket has at most 2 * tol_s + 2 rows.
    """
    tol = F.lit(tol_s)
    marker = (
        markers.groupBy("company_id", "time")
        .agg(F.min(F.struct("type_rank", F.col("signal_id").alias("sid"), "type")).alias("m"))
        .select("company_id", "time", "m", F.floor(F.col("time") / tol).cast("long").alias("b"))
    )
    ends = marker.groupBy("company_id", "b").agg(
        F.max_by("m", "time").alias("last_m"), F.max("time").alias("last_t"),
        F.min_by("m", "time").alias("first_m"), F.min("time").alias("first_t"),
    )
    after = ends.select("company_id", F.col("last_t").alias("time"), F.col("last_m").alias("m"), (F.col("b") + 1).alias("b"))
    before = ends.select("company_id", F.col("first_t").alias("time"), F.col("first_m").alias("m"), (F.col("b") - 1).alias("b"))
    point = (
        points.select("company_id", "time").distinct()
        .withColumn("m", F.lit(None).cast(marker.schema["m"].dataType))
        .withColumn("b", F.floor(F.col("time") / tol).cast("long"))
        .withColumn("is_point", F.lit(True))
    )
    rows = (
        marker.unionByName(after).unionByName(before).withColumn("is_point", F.lit(False))
        .unionByName(point)
        .withColumn("mt", F.when(~F.col("is_point"), F.struct(F.col("time").alias("t"), "m")))
    )
    # Both frames grow from the start of their order, which costs one step per row; a frame
    # that ends at the far side would be evaluated anew for every row.
    group = Window.partitionBy("company_id", "b")
    upto = group.orderBy("time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = group.orderBy(F.desc("time")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        rows.withColumn("n", F.last("mt", ignorenulls=True).over(onward))
        .withColumn("p", F.last("mt", ignorenulls=True).over(upto))
        .filter("is_point")
    )
    back, ahead = F.col("time") - F.col("p.t"), F.col("n.t") - F.col("time")
    use_prev = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    hit = F.when(use_prev, F.col("p")).otherwise(F.col("n"))
    gap = F.when(use_prev, back).otherwise(ahead)
    return found.withColumns({"hit": hit, "distance_s": gap}).filter(F.col("distance_s") < tol_s).select(
        "company_id", "time",
        F.col("hit.m.sid").alias("signal_id"),
        F.col("hit.m.type").alias("type"),
        F.col("hit.t").alias("marker_time"),
        "distance_s",
    )


# --- watchlist --------------------------------------------------------------

def watchlist(*lists: DataFrame) -> DataFrame:
    """Distinct union of (company_id, ordinal) lists, ordered by first occurrence.

    ``list_no`` and ``ordinal`` give the place of the first occurrence.
    """
    tagged = None
    for i, one in enumerate(lists):
        part = one.select("company_id", F.struct(F.lit(i).alias("list_no"), F.col("ordinal").cast("long").alias("ordinal")).alias("place"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("company_id").agg(F.min("place").alias("place")).select(
        "company_id", "place.list_no", "place.ordinal"
    )


def scan_summary(watched: DataFrame, flagged: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of counts: scanned, flagged, findings. The finding ids stay a table."""
    parts = {"scanned": watched, "flagged": flagged, "findings": findings}
    tagged = [df.select(F.lit(name).alias("part")) for name, df in parts.items()]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return rows.agg(*[F.count_if(F.col("part") == name).alias(name) for name in parts])
