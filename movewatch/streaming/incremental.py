"""The findings cycle over what changed: a late bar or a new item re-scores and re-attributes only what depends on it.

What a finding depends on is its company's newest bars and items, and the companies that moved alike: the flagged ones of
its sector, direction and session. So a batch touches the companies of its bars and of changed items, the groups these
were in and are in now, and with them the other members of those groups.

State is kept in buckets by hash: the newest bars, the score and the finding of each company by company, the flagged scores
once more by group. A batch opens the buckets it touches and writes them as folders of its own; a small list says which batch holds the last
version of each bucket. Nothing is changed in place: a batch that is run again starts from its predecessor's list
and finds what it found the first time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from movewatch import schemas
from movewatch.functions.scalar import decode_finding, encode_finding
from movewatch.operators.anomaly import N_WINDOW, score_watchlist
from movewatch.operators.attribution import AttributionParams, attribute, with_session
from movewatch.operators.bars import last_n
from movewatch.operators.joins import lookup
from movewatch.operators.ordered import top_n
from movewatch.session import materialized
from movewatch.sources import sinks
from movewatch.streaming.ingest import BAR_TIES, run_batches
from movewatch.streaming.worker import SCORE

BUCKETS = 64
_GROUP = ["sector", "direction", "session_day"]
_STATE = {
    "bars": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.BAR),
    "scores": f"{SCORE}, sector string, session_day date",
    "movers": f"{SCORE}, sector string, session_day date",
    "findings": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.STORED_FINDING),
}
_LIST = "part string, bucket int, batch long"

#: part and bucket -> the batch that wrote it last; at most as many entries as there are buckets of all parts.
Versions = dict[tuple[str, int], int]


def bucket_of(buckets: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _group_bucket(buckets: int) -> Column:
    """The bucket of a flagged score by its group; without a sector a company is a group by itself."""
    return F.when(F.col("sector").isNotNull(), bucket_of(buckets, *_GROUP)).otherwise(bucket_of(buckets, "company_id"))


def versions(spark: SparkSession, base: str, batch: int) -> Versions:
    """Which batch wrote each bucket last, after the given batch."""
    if batch < 0:
        return {}
    rows = spark.read.schema(_LIST).parquet(f"{base}/versions/after={batch}").collect()
    return {(r["part"], r["bucket"]): r["batch"] for r in rows}


def read_state(spark: SparkSession, base: str, part: str, known: Versions, buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of the wanted buckets, or of all, in their last version; only their folders are opened."""
    wanted = sorted(b for p, b in known if p == part) if buckets is None else buckets
    paths = [f"{base}/{part}/batch={known[part, b]}/bucket={b}" for b in wanted if (part, b) in known]
    reader = spark.read.schema(_STATE[part])
    return reader.parquet(*paths) if paths else spark.createDataFrame([], _STATE[part])


def _numbers(rows: DataFrame, bucket: Column) -> list[int]:
    return sorted(r[0] for r in rows.select(bucket).distinct().collect())


def _write(rows: DataFrame, base: str, part: str, batch: int, bucket: Column, touched: list[int]) -> Versions:
    """Write the touched buckets whole as this batch's version; an emptied bucket gets an empty folder."""
    spark, columns = rows.sparkSession, rows.columns
    path = f"{base}/{part}/batch={batch}"
    placed = rows.withColumn("bucket", bucket)
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    filled = set(_numbers(spark.read.schema(f"{_STATE[part]}, bucket int").parquet(path), F.col("bucket"))) if touched else set()
    for b in touched:
        if b not in filled:
            rows.limit(0).select(columns).write.mode("overwrite").parquet(f"{path}/bucket={b}")
    return {(part, b): batch for b in touched}


def cycle(
    bars: DataFrame,
    dims: dict[str, DataFrame],
    base: str,
    batch: int,
    changed: DataFrame | None = None,
    params: AttributionParams = AttributionParams(),
    order: Sequence[Column] = (),
    n: int = N_WINDOW,
    buckets: int = BUCKETS,
    **scan_params,
) -> None:
    """Bring the findings at ``base`` up to date with a batch of bars and the companies (``company_id``) in ``changed``.

    Afterwards the state is what a full cycle over all bars and the given items would give, provided that ``changed`` names
    the companies of all items, and company records, that are new since the batch before. ``buckets`` stays the same for a ``base``.
    """
    spark = bars.sparkSession
    home, by_group = bucket_of(buckets, "company_id"), _group_bucket(buckets)
    known = versions(spark, base, batch - 1)
    new = sinks.first_of(bars, "bar", list(order) or [F.asc(c) for c in BAR_TIES]).select(schemas.BAR.names)
    new = materialized(new, "cycle-bars")
    moved = new.select("company_id").distinct()
    touched = moved if changed is None else moved.unionByName(changed.select("company_id").filter(F.col("company_id").isNotNull())).distinct()
    touched = materialized(touched, "cycle-touched")
    own = _numbers(touched, home)

    # the newest bars of the touched buckets; a bar that is stored already stays as it is
    stored = read_state(spark, base, "bars", known, own)
    either = new.withColumn("_new", F.lit(1)).unionByName(stored.withColumn("_new", F.lit(0)))
    newest = materialized(last_n(top_n(either, sinks.BAR_KEYS, [F.asc("_new")], 1).drop("_new"), n), "cycle-newest")
    now = _write(newest, base, "bars", batch, home, own)

    before = read_state(spark, base, "scores", known, own)
    again = score_watchlist(newest, touched, n=n, **scan_params)
    placed = with_session(again, params.zone).join(dims["companies"].select("company_id", "sector"), "company_id", "left")
    columns = before.columns
    placed = materialized(placed.select(columns), "cycle-scores")
    others = lookup(before, touched, ["company_id"], "company_id", "left_anti")
    now |= _write(others.unionByName(placed), base, "scores", batch, home, own)

    # the groups that touched companies were in and are in, and all their members
    left = lookup(before, touched, ["company_id"], "company_id", "left_semi").filter("flagged")
    concerned = materialized(left.unionByName(placed.filter("flagged")), "cycle-concerned")
    groups = _numbers(concerned, by_group)
    movers = lookup(read_state(spark, base, "movers", known, groups), touched, ["company_id"], "company_id", "left_anti")
    # a touched company that left for a group of another bucket leaves the old one's bucket too
    movers = materialized(movers.unionByName(placed.filter("flagged")), "cycle-movers")
    now |= _write(movers, base, "movers", batch, by_group, groups)
    keys = concerned.filter(F.col("sector").isNotNull()).select(*_GROUP).distinct()
    beside = lookup(movers, keys, _GROUP, "company_id", "left_semi")
    alone = movers.filter(F.col("sector").isNull()).join(touched, "company_id", "left_semi")
    flagged = materialized(beside.unionByName(alone), "cycle-flagged")

    found = attribute(flagged.drop("sector", "session_day"), dims["news"], dims["discussion"], dims["companies"], params)
    rows = materialized(encode_finding(sinks.finding_rows(found, F.col("anchor_ms"))).select(sinks.stored_columns("finding")), "cycle-findings")
    redone = materialized(touched.unionByName(flagged.select("company_id")).distinct(), "cycle-redone")
    homes = _numbers(redone, home)
    kept = lookup(read_state(spark, base, "findings", known, homes), redone, ["company_id"], "company_id", "left_anti")
    now |= _write(kept.unionByName(rows), base, "findings", batch, home, homes)

    entries = [(part, b, v) for (part, b), v in sorted({**known, **now}.items())]
    spark.createDataFrame(entries, _LIST).coalesce(1).write.mode("overwrite").parquet(f"{base}/versions/after={batch}")


def findings(spark: SparkSession, base: str, batch: int) -> DataFrame:
    """The findings that hold after a batch."""
    return decode_finding(read_state(spark, base, "findings", versions(spark, base, batch)))


def unusable(spark: SparkSession, base: str, batch: int) -> DataFrame:
    """The companies that could not be scored after a batch."""
    scores = read_state(spark, base, "scores", versions(spark, base, batch))
    return scores.filter(F.col("status") != "ok").select("company_id", "anchor_ms", "status")


def drop_old(spark: SparkSession, base: str, batch: int) -> int:
    """Delete the folders that neither this batch's state nor its predecessor's needs; returns their number."""
    needed = {(p, v) for b in (batch, batch - 1) for (p, _), v in versions(spark, base, b).items()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for part in _STATE:
        for old in range(batch):
            folder = path(f"{base}/{part}/batch={old}")
            if (part, old) not in needed and fs.exists(folder):
                gone += fs.delete(folder, True)
    return gone


def stream_findings(
    bars: DataFrame,
    dims: Callable[[SparkSession, int], dict[str, DataFrame]],
    base: str,
    checkpoint: str,
    changed: Callable[[SparkSession, int], DataFrame | None] = lambda spark, batch: None,
    every: str | None = None,
    params: AttributionParams = AttributionParams(),
    arrival: Sequence[str] = (),
    **scan_params,
) -> StreamingQuery:
    """``scan.stream_findings`` at the cost of what changes: bars in, findings at ``base``.

    ``dims`` opens companies, news and discussion in every cycle; ``changed`` names the companies whose items or records
    are new since the batch before. What holds after the last batch does not depend on how the bars were cut.
    """
    order = [F.asc(c) for c in [*arrival, *BAR_TIES]]

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cycle(batch, dims(spark, batch_id), base, batch_id, changed(spark, batch_id), params, order, **scan_params)

    return run_batches(bars, each, checkpoint, every)
