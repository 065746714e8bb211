"""Abnormal moves: z-score of the latest return and volume ratio, for all companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from movewatch.functions.scalar import ratio
from movewatch.operators.bars import DAY_BUCKET, anchors, last_n
from movewatch.operators.joins import lookup
from movewatch.operators.ordered import positions, time_bucket
from movewatch.schemas import MS_PER_DAY

# --- fixed values: scan defaults --------------------------------------------
N_WINDOW = 30
Z_THRESHOLD = 2.0
VOL_THRESHOLD = 2.5
# ----------------------------------------------------------------------------


def _missing(name: str) -> Column:
    """NULL or NaN; Spark orders NaN above all numbers, so it must not reach a comparison."""
    return F.col(name).isNull() | F.isnan(F.col(name).cast("double"))


def _statistics() -> list:
    bad = _missing("close") | _missing("volume") | F.coalesce(F.col("prev_close") == 0, F.lit(False))
    return [
        F.count(F.lit(1)).alias("n_bars"),
        F.max("ts_ms").alias("anchor_ms"),
        F.max_by("close", "ts_ms").alias("latest_close"),
        F.max_by("ret", "ts_ms").alias("latest_return"),
        F.avg("ret").alias("_mean"),
        F.stddev_pop("ret").alias("_std"),
        F.max_by("volume", "ts_ms").cast("double").alias("_volume"),
        F.avg("volume").alias("_mean_volume"),
        F.bool_or(bad).alias("_bad"),
    ]


def _score(stats: DataFrame) -> DataFrame:
    ok = ~F.col("_bad") & (F.col("n_bars") >= 2)
    z = F.coalesce(ratio(F.col("latest_return") - F.col("_mean"), F.col("_std")), F.lit(0.0))
    vol = F.coalesce(ratio(F.col("_volume"), F.col("_mean_volume")), F.lit(0.0))
    direction = F.when(F.col("latest_return") > 0, "up").otherwise("down")
    return stats.select(
        "company_id",
        "n_bars",
        "anchor_ms",
        F.when(~_missing("latest_close"), F.col("latest_close")).alias("latest_close"),
        F.when(ok, F.col("latest_return")).alias("latest_return"),
        F.when(ok, z).alias("z_score"),
        F.when(ok, vol).alias("volume_ratio"),
        F.when(ok, direction).alias("direction"),
        F.when(F.col("_bad"), "bad_data").otherwise("ok").alias("status"),
    )


def score_watchlist(
    bars: DataFrame,
    watchlist: DataFrame | None = None,
    n: int = N_WINDOW,
    z: float = Z_THRESHOLD,
    vol: float = VOL_THRESHOLD,
    min_bars: int | None = None,
) -> DataFrame:
    """Score the newest n bars of every company; one row per company scored.

    Companies with fewer than ``min_bars`` (default n) bars are left out. Mean, deviation
    and mean volume include the latest bar. ``flagged`` compares unrounded values. A
    company with a NULL or NaN close or volume, or a zero previous close, gets status 'bad_data'
    and NULL scores, and does not disturb the others.

    One shuffle, by company: each map task keeps n bars per company, the returns reuse
    the sort of the cut (descending, so ``lead`` is the earlier bar) and the aggregate
    reuses its partitioning.
    """
    if watchlist is not None:
        bars = lookup(bars, watchlist.select("company_id"), ["company_id"], "ts_ms", "left_semi")
    newest_first = Window.partitionBy("company_id").orderBy(F.desc("ts_ms"))
    window = (
        last_n(bars.select("company_id", "ts_ms", "close", "volume"), n)
        .withColumn("prev_close", F.lead("close").over(newest_first))
        .withColumn("ret", ratio(F.col("close"), F.col("prev_close")) - 1)
    )
    stats = window.groupBy("company_id").agg(*_statistics())
    stats = stats.filter(F.col("n_bars") >= (n if min_bars is None else min_bars))
    hit = (F.abs("z_score") >= z) | (F.col("volume_ratio") >= vol)
    return _score(stats).withColumn("flagged", F.coalesce(hit, F.lit(False)))


def backfill_scores(
    bars: DataFrame,
    n: int = N_WINDOW,
    z: float = Z_THRESHOLD,
    vol: float = VOL_THRESHOLD,
    min_bars: int | None = None,
    block: int = 1024,
    bucket_ms: int = DAY_BUCKET,
) -> DataFrame:
    """What ``score_watchlist`` would have said at every bar: one row per company and bar with at least ``min_bars`` bars so far.

    A company's bars are numbered and cut into blocks of ``block``; the last n - 1 bars of a block also go to the next
    one, as the halo its first windows reach back into. So a company with any share of the bars is spread over as many
    tasks as it has blocks, and the windows are bounded frames inside a block.
    """
    if block < n:
        raise ValueError("a block must hold a whole window")
    narrow = bars.select("company_id", "ts_ms", "close", "volume")
    placed = positions(narrow, ["company_id"], ["ts_ms"], time_bucket("ts_ms", bucket_ms))
    own = F.floor(F.col("position") / F.lit(block))
    copies = F.when(F.col("position") % block > block - n, F.array(own, own + 1)).otherwise(F.array(own))
    rows = placed.withColumn("_own", own).withColumn("_block", F.explode(copies))
    inside = Window.partitionBy("company_id", "_block").orderBy("position")
    window, steps = inside.rowsBetween(-(n - 1), 0), inside.rowsBetween(-(n - 2), 0)
    rows = rows.withColumn("prev_close", F.lag("close").over(inside)).withColumn("ret", ratio(F.col("close"), F.col("prev_close")) - 1)
    missing = F.max((_missing("close") | _missing("volume")).cast("int")).over(window) == 1
    from_zero = F.max(F.coalesce(F.col("prev_close") == 0, F.lit(False)).cast("int")).over(steps) == 1
    stats = rows.select(
        "company_id", "_own", "_block",
        F.least(F.col("position") + 1, F.lit(n)).cast("long").alias("n_bars"),
        F.col("ts_ms").alias("anchor_ms"),
        F.col("close").alias("latest_close"),
        F.col("ret").alias("latest_return"),
        F.avg("ret").over(steps).alias("_mean"),
        F.stddev_pop("ret").over(steps).alias("_std"),
        F.col("volume").cast("double").alias("_volume"),
        F.avg("volume").over(window).alias("_mean_volume"),
        (missing | from_zero).alias("_bad"),
    )
    stats = stats.filter((F.col("_own") == F.col("_block")) & (F.col("n_bars") >= (n if min_bars is None else min_bars)))
    hit = (F.abs("z_score") >= z) | (F.col("volume_ratio") >= vol)
    return _score(stats).withColumn("flagged", F.coalesce(hit, F.lit(False)))


def with_trigger(scores: DataFrame, digits: int = 2) -> DataFrame:
    """Adds the rounded trigger struct stored with a finding."""
    return scores.withColumn(
        "trigger",
        F.struct(
            F.round("z_score", digits).alias("z_score"),
            F.round("volume_ratio", digits).alias("volume_ratio"),
            F.col("direction").alias("direction"),
            F.round(F.col("latest_return") * 100, digits).alias("latest_return_pct"),
        ),
    )


def scan_watchlist(bars: DataFrame, watchlist: DataFrame | None = None, **params) -> DataFrame:
    """The flagged companies with their trigger."""
    return with_trigger(score_watchlist(bars, watchlist, **params).filter("flagged"))


def compute_trigger(bars: DataFrame, watchlist: DataFrame | None = None, min_bars: int = 2, n: int = N_WINDOW) -> DataFrame:
    """Trigger of named companies, flagged or not, from as few as two bars."""
    return with_trigger(score_watchlist(bars, watchlist, n=n, min_bars=min_bars))


def assert_all_flagged(scores: DataFrame) -> DataFrame:
    """One row: companies scored, companies flagged, and whether all of them fired."""
    return scores.agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if("flagged").alias("fired"),
        F.coalesce(F.bool_and("flagged"), F.lit(False)).alias("all_fired"),
    )


def movement_window(bars: DataFrame, days: int = 30) -> DataFrame:
    """Bars of the last ``days`` calendar days before each company's anchor, start included."""
    anchor, span = anchors(bars), F.lit(days * MS_PER_DAY)
    # what is older than every company's window is left at the scan
    earliest = anchor.agg(F.min("anchor_ms") - span).scalar()
    return (
        lookup(bars.filter(F.col("ts_ms") >= earliest), anchor, ["company_id"], "ts_ms")
        .filter(F.col("ts_ms") >= F.col("anchor_ms") - span)
        .drop("anchor_ms")
    )


def _digests(window: DataFrame, bucket_ms: int) -> DataFrame:
    """One row per company and time bucket: its ends, and the moments of the returns inside.

    The window and the aggregate share the shuffle by (company, bucket), so a company with a
    large share of the bars is spread over as many tasks as it has buckets.
    """
    inside = Window.partitionBy("company_id", "_bucket").orderBy("ts_ms")
    inner = ratio(F.col("close"), F.col("_lag")) - 1
    rows = (
        window.withColumn("_bucket", time_bucket("ts_ms", bucket_ms))
        .withColumn("_lag", F.lag("close").over(inside))
        .withColumn("_ret", inner)
    )
    bad = _missing("close") | _missing("volume") | F.coalesce(F.col("_lag") == 0, F.lit(False))
    return rows.groupBy("company_id", "_bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("close", "ts_ms").alias("first_close"),
        F.max_by("close", "ts_ms").alias("last_close"),
        F.max("ts_ms").alias("last_ts"),
        F.max_by("volume", "ts_ms").alias("last_volume"),
        F.sum("volume").alias("volume"),
        F.max_by("_ret", "ts_ms").alias("last_inner"),
        F.count("_ret").alias("k"),
        F.coalesce(F.avg("_ret"), F.lit(0.0)).alias("m"),
        F.coalesce(F.var_pop("_ret"), F.lit(0.0)).alias("v"),
        F.bool_or(bad).alias("bad"),
    )


def day_digests(bars: DataFrame, bucket_ms: int = DAY_BUCKET) -> DataFrame:
    """The digests of all bars, one row per company and day (``_bucket``, days since 1970): what ``movement_of`` puts together."""
    return _digests(bars, bucket_ms)


def _merge_digests(digests: DataFrame) -> DataFrame:
    """Per-company statistics from its digests, as ``_statistics`` gives them from bars.

    The returns are those inside the buckets plus one from each bucket to the next. Mean and
    variance are put together from the parts, around the common mean.
    """
    company = Window.partitionBy("company_id")
    in_time = company.orderBy("_bucket")
    carried = (
        digests.withColumn("_before", F.lag("last_close").over(in_time))
        .withColumn("step", ratio(F.col("first_close"), F.col("_before")) - 1)
        .withColumn("stepped", F.col("step").isNotNull().cast("long"))
    )
    total = F.sum(F.col("k") + F.col("stepped")).over(company)
    summed = F.sum(F.col("k") * F.col("m") + F.coalesce("step", F.lit(0.0))).over(company)
    centred = carried.withColumn("_total", total).withColumn("_mean", summed / F.nullif("_total", F.lit(0)))
    square = (
        F.col("k") * F.col("v")
        + F.col("k") * F.pow(F.col("m") - F.col("_mean"), 2)
        + F.coalesce(F.pow(F.col("step") - F.col("_mean"), 2), F.lit(0.0))
    )
    zero_before = F.coalesce(F.col("_before") == 0, F.lit(False))
    newest = F.when(F.col("n") > 1, F.col("last_inner")).otherwise(F.col("step"))
    n_bars, returns = F.sum("n"), F.max("_total")
    return centred.groupBy("company_id").agg(
        n_bars.alias("n_bars"),
        F.max("last_ts").alias("anchor_ms"),
        F.max_by("last_close", "last_ts").alias("latest_close"),
        F.max_by(newest, "last_ts").alias("latest_return"),
        F.max("_mean").alias("_mean"),
        F.sqrt(F.sum(square) / F.nullif(returns, F.lit(0))).alias("_std"),
        F.max_by("last_volume", "last_ts").cast("double").alias("_volume"),
        (F.sum("volume") / n_bars).alias("_mean_volume"),
        F.bool_or(F.col("bad") | zero_before).alias("_bad"),
    )


def price_movement(
    bars: DataFrame, companies: DataFrame, days: int = 30, digits: int = 4, bucket_ms: int = DAY_BUCKET
) -> DataFrame:
    """Movement over a calendar window ending at the anchor, one row per company.

    A company without bars gets NULLs; with one bar only its unrounded close. The
    matching series is ``series(movement_window(bars, days))``. The window may hold any
    number of bars, so it is digested per day first and the days are put together.
    """
    window = movement_window(bars.select("company_id", "ts_ms", "close", "volume"), days)
    return movement_of(_digests(window, bucket_ms), companies, digits)


def movement_of(digests: DataFrame, companies: DataFrame, digits: int = 4) -> DataFrame:
    """The movement of every company from the digests of its window."""
    scored = _score(_merge_digests(digests))
    many = F.col("n_bars") >= 2
    result = scored.select(
        "company_id",
        "n_bars",
        F.when(many, F.round("latest_close", digits)).otherwise(F.col("latest_close")).alias("latest_close"),
        F.round(F.col("latest_return") * 100, digits).alias("latest_return_pct"),
        F.round("z_score", digits).alias("z_score"),
        F.round("volume_ratio", digits).alias("volume_ratio"),
        "direction",
    )
    return (
        companies.select("company_id")
        .join(result, "company_id", "left")
        .withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))
    )
