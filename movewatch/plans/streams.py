"""Queries that run a stream over the events until it has read them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movewatch.operators.attribution import AttributionParams
from movewatch.plans.bindings import AS_OF_MS, NEWS_LEAST, SCHEMAS, Market
from movewatch.plans.catalog import query, score_sql
from movewatch.plans.market import _SCORE_COLUMNS
from movewatch.plans.signals import NEWS_ROWS, POST_ROWS
from movewatch.session import fresh_dir
from movewatch.sources import feeds, sinks
from movewatch.streaming import incremental, ingest, scan


class StreamMarket(Market):
    """The same views with events read as a stream."""

    def table(self, name: str) -> DataFrame:
        if name != "events":
            return super().table(name)
        # a file stream takes a folder or a pattern
        return self.spark.readStream.schema(SCHEMAS[name]).parquet(f"{self.dir}/event[s].parquet")


def _stream(m: Market) -> StreamMarket:
    return StreamMarket(m.spark, m.dir)


@query("ss1_stream_ingest", """
SELECT company_id, ts_ms, round(close, 6) AS close, volume FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, ts_ms ORDER BY event_id) AS copy FROM (
    SELECT company_id, ms AS ts_ms, value AS close, cast(k AS bigint) AS volume,
      ms > coalesce(min(ms) FILTER (event_id % 23 = 2 AND event_id % 89 <> 1) OVER (PARTITION BY company_id, ms // 86400000), 9e18) AS late,
      event_id FROM ev) WHERE NOT late AND event_id % 89 <> 1 AND event_id % 23 <> 2) WHERE copy = 1""")
def stream_ingest(m: Market) -> DataFrame:
    base = fresh_dir(m.spark, "ingest")
    run = ingest.stream_ingest(_stream(m).bar_feed, "bar", f"{base}/bars", f"{base}/checkpoint", poll=["poll_day"], arrival=["event_id"])
    run.awaitTermination()
    return sinks.open_table(m.spark, "bar", f"{base}/bars").select("company_id", "ts_ms", "close", "volume")


def _landing(m: Market, polls: DataFrame, base: str) -> None:
    """Polls as files of JSON lines, a line in 50 of them cut short."""
    line = F.to_json(F.struct("ticker", "payload"))
    broken = F.pmod(F.xxhash64("ticker", "payload"), F.lit(50)) == 7
    cut = polls.filter(broken).select(F.substring(line, 1, 30).alias("value"))
    polls.select(line.alias("value")).unionByName(cut).repartition(6).write.text(f"{base}/landing")


def _landed_stream(m: Market, kind: str, polls: DataFrame) -> DataFrame:
    base = fresh_dir(m.spark, f"landed-{kind}")
    _landing(m, polls, base)
    stream = feeds.landed(m.spark, kind, f"{base}/landing", stream=True, files_per_batch=3)
    ingest.stream_ingest(stream, kind, f"{base}/{kind}", f"{base}/checkpoint").awaitTermination()
    return sinks.open_table(m.spark, kind, f"{base}/{kind}")


# Of an article that comes twice the first by company, time and place stays, if both are in a batch; over batches
# the earlier batch's. What doesn't depend on the cut is what is compared.
@query("ss1_stream_news", f"""
SELECT id, min(headline) AS headline, min(url) AS url FROM ({NEWS_ROWS}) WHERE reason IS NULL GROUP BY id HAVING count(*) = 1
UNION ALL
SELECT id, NULL, min(url) FROM ({NEWS_ROWS}) WHERE reason IS NULL GROUP BY id HAVING count(*) > 1""")
def stream_news(m: Market) -> DataFrame:
    """Articles stored from a landing folder; the headline is shown where only one poll had the article."""
    often = feeds.accepted(feeds.ingest_news(m.news_polls)).groupBy("id").agg((F.count(F.lit(1)) > 1).alias("twice"))
    stored = _landed_stream(m, "news", m.news_polls).join(often, "id", "left")
    return stored.select("id", F.when(~F.col("twice"), F.col("headline")).alias("headline"), "url")


@query("ss1_stream_discussion", f"""
SELECT id, company_id, title, source, url, published_at FROM ({POST_ROWS}) WHERE reason IS NULL""")
def stream_discussion(m: Market) -> DataFrame:
    return _landed_stream(m, "discussion", m.discussion_polls).select("id", "company_id", "title", "source", "url", "published_at")


@query("ss2_stream_dedup", "SELECT company_id, ts_ms // 3600000 AS hour FROM bar")
def stream_dedup(m: Market) -> DataFrame:
    """First event of each company and hour."""
    base = fresh_dir(m.spark, "dedup")
    events = _stream(m).events.select(
        "company_id", F.col("ts").cast("timestamp").alias("at"), F.floor(F.col("ms") / F.lit(3_600_000)).alias("hour")
    )
    first = ingest.stream_dedup(events, ["company_id", "hour"], "at", "1 day")
    writer = first.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return m.spark.read.parquet(f"{base}/out").select("company_id", "hour")


@query("ss3_stream_scan", f"SELECT {_SCORE_COLUMNS} FROM ({score_sql('tick')})")
def stream_scan(m: Market) -> DataFrame:
    base = fresh_dir(m.spark, "scan")
    scan.stream_scores(_stream(m).ticks, f"{base}/scores", f"{base}/checkpoint").awaitTermination()
    emitted = m.spark.read.schema(f"{scan.SCORE}, batch_id bigint").parquet(f"{base}/scores")
    return scan.latest_scores(emitted)


_FINDINGS = """
SELECT company_id, anchor_ms AS created_at, driver AS primary_driver, confidence, driver = 'unexplained' AS needs_human_review,
  round(z_score, 2) AS z_score, direction,
  CASE driver WHEN 'news' THEN least(3, news_causal) WHEN 'discussion' THEN least(3, posts_causal) WHEN 'sector' THEN least(3, peers_alike) ELSE 0 END::INT AS n_evidence
FROM attributed"""


@query("ss4_stream_findings", _FINDINGS,
       views={"score03": score_sql("tick", z=0.3)})
def stream_findings(m: Market) -> DataFrame:
    base = fresh_dir(m.spark, "findings")

    def dims(spark: SparkSession) -> dict[str, DataFrame]:
        now = Market(spark, m.dir)
        return {"companies": now.companies, "news": now.news, "discussion": now.discussion}

    run = scan.stream_findings(
        _stream(m).ticks, dims, f"{base}/bars", f"{base}/findings", f"{base}/checkpoint",
        params=AttributionParams(min_news=NEWS_LEAST), z=0.3,
    )
    run.awaitTermination()
    return sinks.latest_cycle(m.spark, f"{base}/findings").select(
        "company_id", "created_at", "primary_driver", "confidence", "needs_human_review",
        "trigger.z_score", "trigger.direction", F.size("evidence").alias("n_evidence"),
    )


@query("ss4_incremental_findings", _FINDINGS, views={"score03": score_sql("tick", z=0.3)})
def incremental_findings(m: Market) -> DataFrame:
    """The same findings from batches that each re-score and re-attribute only what they change; the news of the
    last days arrives with the last batch."""
    base = fresh_dir(m.spark, "incremental")
    for part in range(3):  # three files, dealt by bar, so that late bars come in every batch
        rows = m.ticks.filter(F.pmod(F.xxhash64("company_id", "ts_ms"), F.lit(3)) == part)
        rows.coalesce(1).write.mode("append").parquet(f"{base}/landing")
    stream = m.spark.readStream.schema(m.ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")
    late = F.col("published_at") >= AS_OF_MS - 86_400_000 * 4

    def dims(spark: SparkSession, batch: int) -> dict[str, DataFrame]:
        now = Market(spark, m.dir)
        news = now.news if batch == 2 else now.news.filter(~late)
        return {"companies": now.companies, "news": news, "discussion": now.discussion}

    def changed(spark: SparkSession, batch: int) -> DataFrame | None:
        return Market(spark, m.dir).news.filter(late).select("company_id") if batch == 2 else None

    run = incremental.stream_findings(
        stream, dims, f"{base}/state", f"{base}/checkpoint", changed, params=AttributionParams(min_news=NEWS_LEAST), z=0.3, buckets=8
    )
    run.awaitTermination()
    return incremental.findings(m.spark, f"{base}/state", 2).select(
        "company_id", "created_at", "primary_driver", "confidence", "needs_human_review",
        "trigger.z_score", "trigger.direction", F.size("evidence").alias("n_evidence"),
    )
