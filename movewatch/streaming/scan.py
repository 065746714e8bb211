"""The anomaly scan and the findings cycle as streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from movewatch import schemas
from movewatch.operators.anomaly import N_WINDOW, VOL_THRESHOLD, Z_THRESHOLD, score_watchlist
from movewatch.operators.attribution import AttributionParams, attribute
from movewatch.operators.bars import last_n
from movewatch.operators.ordered import top_n
from movewatch.session import STATE_STORE
from movewatch.sources import sinks
from movewatch.streaming.ingest import BAR_TIES, run_batches
from movewatch.streaming.worker import SCORE, NewestBarsScan, newest_bars


def stream_scan(
    bars: DataFrame,
    n: int = N_WINDOW,
    z: float = Z_THRESHOLD,
    vol: float = VOL_THRESHOLD,
    min_bars: int | None = None,
) -> DataFrame:
    """Scores of every company a batch touches, flagged or not, as a stream.

    A late bar that is among the newest n is put in its place; an older one changes
    nothing. State is n bars per company.
    """
    spark = bars.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    wanted = bars.select("company_id", "ts_ms", "close", "volume")
    cut = wanted.mapInPandas(newest_bars(n), wanted.schema)
    scan = NewestBarsScan(n, z, vol, n if min_bars is None else min_bars)
    return cut.groupBy("company_id").transformWithStateInPandas(
        statefulProcessor=scan, outputStructType=SCORE, outputMode="Update", timeMode="None"
    )


def latest_scores(emitted: DataFrame) -> DataFrame:
    """The newest score of each company among all that a scan emitted with their batch_id."""
    newest = F.max_by(F.struct(*[c for c in emitted.columns if c != "batch_id"]), "batch_id")
    return emitted.groupBy("company_id").agg(newest.alias("s")).select("s.*")


def stream_scores(bars: DataFrame, target: str, checkpoint: str, every: str | None = None, **params) -> StreamingQuery:
    """``stream_scan`` written to ``target``, one folder per batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    scan = stream_scan(bars, **params)
    writer = scan.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _newest(batch: DataFrame, path: str, batch_id: int, n: int, order: Sequence[Column]) -> DataFrame:
    """The newest n bars of every company after this batch, kept in a table of their own.

    Two folders take turns: a batch reads the one its predecessor wrote and overwrites the
    other, so a batch that is run again finds what it found the first time. A bar that is stored
    already stays as it is.
    """
    spark, columns = batch.sparkSession, sinks.stored_columns("bar")
    rows = sinks.first_of(batch, "bar", order).select(*columns).withColumn("_new", F.lit(1))
    if batch_id:
        before = spark.read.schema(schemas.BAR).parquet(f"{path}/{(batch_id - 1) % 2}").withColumn("_new", F.lit(0))
        rows = top_n(rows.unionByName(before), sinks.BAR_KEYS, [F.asc("_new")], 1)
    slot = f"{path}/{batch_id % 2}"
    last_n(rows.drop("_new"), n).write.mode("overwrite").parquet(slot)
    return spark.read.schema(schemas.BAR).parquet(slot)


def scan_cycle(
    bars: DataFrame,
    dims: dict[str, DataFrame],
    findings_path: str,
    cycle: int,
    params: AttributionParams = AttributionParams(),
    **scan_params,
) -> None:
    """One cycle: score the whole watchlist, attribute all flagged companies, store the findings.

    The findings of a cycle are a folder of their own, which a repeated cycle overwrites. Companies that
    could not be scored go to ``findings_path + '_rejected'``; they do not stop the others.
    """
    scores = score_watchlist(bars, **scan_params).persist()
    try:
        found = attribute(scores.filter("flagged"), dims["news"], dims["discussion"], dims["companies"], params)
        sinks.write_cycle(sinks.finding_rows(found, F.col("anchor_ms")), findings_path, cycle)
        bad = scores.filter(F.col("status") != "ok").select("company_id", "anchor_ms", "status")
        bad.write.mode("overwrite").parquet(f"{findings_path}_rejected/cycle={cycle}")
    finally:
        scores.unpersist()


def stream_findings(
    bars: DataFrame,
    dims: Callable[[SparkSession], dict[str, DataFrame]],
    bars_path: str,
    findings_path: str,
    checkpoint: str,
    every: str | None = None,
    params: AttributionParams = AttributionParams(),
    arrival: Sequence[str] = (),
    n: int = N_WINDOW,
    **scan_params,
) -> StreamingQuery:
    """Bars in, findings out: store the batch, then run a cycle over the whole watchlist.

    ``dims`` opens companies, news and discussion and is called in every cycle, so items that were stored
    meanwhile count. As each cycle looks at all companies, a move that others of its sector join later is
    attributed anew, and the last cycle's findings do not depend on how the bars were cut into batches.

    A cycle reads the newest n bars of each company from a table of their own (``bars_path + '_newest'``) and
    of the items those since the earliest window; the cost of a cycle follows the number of companies and not the history.
    """
    order = [F.asc(c) for c in [*arrival, *BAR_TIES]]

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            sinks.append_table(rows, "bar", bars_path, order)
            newest = _newest(rows, f"{bars_path}_newest", batch_id, n, order)
            scan_cycle(newest, dims(batch.sparkSession), findings_path, batch_id, params, n=n, **scan_params)
        finally:
            rows.unpersist()

    return run_batches(bars, each, checkpoint, every)
