"""Feeds as streams: exactly-once ingest into stored tables, and bounded-state dedup."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from movewatch.session import configure
from movewatch.sources import feeds, sinks

KINDS: dict[str, Callable[..., DataFrame]] = {
    "bar": feeds.ingest_bars,
    "news": feeds.ingest_news,
    "discussion": feeds.ingest_discussion,
}
# Items carry their place in the poll. Bars come row by row: the feed names its order itself.
ORDERS = {
    "news": ["company_id", "published_at", "pos"],
    "discussion": ["company_id", "published_at", "pos"],
}
# Without an arrival order, copies of a bar in one batch are told apart by their values only.
BAR_TIES = ["close", "volume", "open", "high", "low"]


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Start ``each`` on the stream's batches: every interval, or once over what is there.

    Spark turns adaptive execution off in a stream's session, as state must keep its
    partitions. The jobs of ``each`` are plain batch jobs and get it back.
    """
    def with_settings(batch: DataFrame, batch_id: int) -> None:
        configure(batch.sparkSession)
        each(batch, batch_id)

    writer = stream.writeStream.foreachBatch(with_settings).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_ingest(
    raw: DataFrame, kind: str, target: str, checkpoint: str, every: str | None = None, arrival: Sequence[str] = (), **options
) -> StreamingQuery:
    """Feed rows into the table at ``target``, refused rows into ``target + '_rejected'``.

    Rows may be as late as they like. A repeated batch adds nothing: stored keys are skipped
    and the refused rows of a batch overwrite themselves. What is stored does not depend on where
    the stream is cut into batches, given that

    * a poll is one input row (news, discussion), or for bars ``poll`` names its columns, or
      ``on_bad='row'`` refuses bad rows only: one of the two is required;
    * ``arrival`` names the bar feed's columns that say in which order rows came, so that the first
      copy of a bar wins in a batch as it does between batches.

    ``raw`` may be a landing folder (``feeds.landed``): its unreadable lines go into ``target + '_corrupt'``.
    """
    convert = KINDS[kind]
    if kind == "bar":
        if options.get("on_bad", "stop") == "stop" and not options.get("poll"):
            raise ValueError("a stream of bars needs the columns of a poll, or on_bad='row'")
        options["arrival"] = arrival
    order = [F.asc(c) for c in ORDERS.get(kind, [*arrival, *BAR_TIES])]

    def each(batch: DataFrame, batch_id: int) -> None:
        if "corrupt" in batch.columns:
            feeds.corrupt(batch).write.mode("overwrite").parquet(f"{target}_corrupt/batch_id={batch_id}")
            batch = feeds.readable(batch)
        rows = convert(batch, **options).persist()
        try:
            good = feeds.accepted(rows)
            sinks.append_table(good, kind, target, order)
            refused = feeds.rejected(rows).unionByName(sinks.unusable(good, kind))
            refused.write.mode("overwrite").parquet(f"{target}_rejected/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return run_batches(raw, each, checkpoint, every)


def stream_dedup(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """First arrival per key, remembering keys only for ``delay`` behind the watermark.

    For feeds too large to look up the stored table: a copy later than that passes.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
