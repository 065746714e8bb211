"""Feed payloads to table rows.

Each function keeps every row it was given the right to keep and adds ``reason``: NULL for
a row to store, else why it is refused. ``accepted`` and ``rejected`` split the result.

A feed row that cannot be converted also ends its poll: with ``on_bad='stop'`` the later
rows of the same payload are refused as 'after_bad'; ``on_bad='row'`` refuses only itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movewatch.functions.scalar import iso_to_ms
from movewatch.operators.joins import lookup

PER_FEED = 5

# --- fixed values: feed constants -------------------------------------------
DISCUSSION_SOURCE = "Stocktwits"
MESSAGE_URL = "https://stocktwits.com/message/"
# ----------------------------------------------------------------------------

NEWS_PAYLOAD = "array<struct<id:string,content:struct<title:string,summary:string,pubDate:string,canonicalUrl:struct<url:string>,provider:struct<displayName:string>>>>"
DISCUSSION_PAYLOAD = "struct<messages:array<struct<id:string,body:string,created_at:string>>>"


#: Columns of a landed file by kind: a line is a poll for news and discussion, a price row for bars.
POLL = "ticker string, payload string"
PRICE_ROW = "ticker string, ts string, open string, high string, low string, close string, volume string"
_CORRUPT = "_corrupt_record"


def landed(spark: SparkSession, kind: str, folder: str, extra: str = "", stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Files of JSON lines in a landing folder, as polls or price rows with ``file`` and ``corrupt``.

    The schema is pinned: no file is read to guess it and a field that is not named is passed over. A payload may
    be JSON inside the line or a string. A line that is no JSON object keeps its text in ``corrupt``; ``readable``
    and ``corrupt`` split the rows, so that unreadable lines can be set aside by file. ``extra`` names further columns, such as those
    of a poll. With ``stream`` the folder is followed, at most ``files_per_batch`` new files at a time.
    """
    schema = (PRICE_ROW if kind == "bar" else POLL) + (f", {extra}" if extra else "") + f", {_CORRUPT} string"
    reader = spark.readStream if stream else spark.read
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # lines as text, parsed here: a JSON scan refuses to give the unreadable lines alone
    lines = reader.text(folder).filter(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.withColumn("row", F.from_json("value", schema, {"columnNameOfCorruptRecord": _CORRUPT}))
    unread = F.col("row").isNull() | F.col(f"row.{_CORRUPT}").isNotNull()
    return parsed.select("row.*", "file", F.when(unread, F.col("value")).alias("corrupt")).drop(_CORRUPT)


def readable(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("corrupt").isNull()).drop("corrupt", "file")


def corrupt(rows: DataFrame) -> DataFrame:
    """The lines that could not be read, with their file."""
    return rows.filter(F.col("corrupt").isNotNull()).select("file", "corrupt")


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNull()).drop("reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNotNull())


def _stop_at_bad(reasons: Column, on_bad: str) -> Column:
    """Reasons of one payload's rows, with everything behind the first bad one refused."""
    if on_bad == "row":
        return reasons
    if on_bad != "stop":
        raise ValueError(f"on_bad must be 'stop' or 'row', not {on_bad!r}")
    first = F.array_position(F.transform(reasons, lambda r: F.coalesce(r.startswith("bad_"), F.lit(False))), True)
    return F.transform(
        reasons,
        lambda r, i: F.when((first > 0) & (i >= first), F.lit("after_bad")).otherwise(r),
    )


def _rows(items: DataFrame, reason_of, on_bad: str) -> DataFrame:
    """Explode the ``items`` array with its reasons; feed order is kept in ``pos``.

    A poll without a readable array gives one row, with reason 'bad_payload'.
    """
    nothing = F.array(F.lit(None).cast(items.schema["items"].dataType.elementType))
    marked = items.withColumn(
        "reasons",
        F.when(F.col("items").isNull(), F.array(F.lit("bad_payload")))
        .otherwise(_stop_at_bad(F.transform("items", reason_of), on_bad)),
    ).withColumn("items", F.coalesce("items", nothing))
    return marked.select(
        "ticker", F.posexplode(F.arrays_zip("items", "reasons")).alias("pos", "z")
    ).select("ticker", "pos", F.col("z.items").alias("a"), F.col("z.reasons").alias("reason"))


def ingest_news(raw: DataFrame, on_bad: str = "stop") -> DataFrame:
    """(ticker, payload JSON) polls to news rows.

    The first five articles count; one without a URL is dropped after that cut.
    """
    # a lone object would be read as an array of one
    parsed = F.when(F.col("payload").rlike(r"^\s*\["), F.from_json("payload", NEWS_PAYLOAD))
    items = raw.select("ticker", F.slice(parsed, 1, PER_FEED).alias("items"))

    def reason(a: Column) -> Column:
        content = a["content"]
        return (
            F.when(F.coalesce(content["canonicalUrl"]["url"], F.lit("")) == "", "no_url")
            .when(a["id"].isNull(), "bad_id")
            .when(iso_to_ms(content["pubDate"]).isNull(), "bad_date")
        )

    rows = _rows(items, reason, on_bad)
    content = F.col("a.content")
    blank = F.lit("")
    return rows.select(
        F.col("a.id").alias("id"),
        F.col("ticker").alias("company_id"),
        F.coalesce(content["title"], blank).alias("headline"),
        F.coalesce(content["summary"], blank).alias("summary"),
        F.coalesce(content["provider"]["displayName"], blank).alias("source"),
        content["canonicalUrl"]["url"].alias("url"),
        iso_to_ms(content["pubDate"]).alias("published_at"),
        "pos",
        "reason",
    )


def ingest_discussion(
    raw: DataFrame, on_bad: str = "stop", source: str = DISCUSSION_SOURCE, url: str = MESSAGE_URL
) -> DataFrame:
    """(ticker, payload JSON) polls to discussion rows: the first five messages."""
    parsed = F.from_json("payload", DISCUSSION_PAYLOAD)["messages"]
    items = raw.select("ticker", F.slice(parsed, 1, PER_FEED).alias("items"))

    def reason(m: Column) -> Column:
        return (
            F.when(m["id"].isNull(), "bad_id")
            .when(m["body"].isNull(), "bad_body")
            .when(iso_to_ms(m["created_at"]).isNull(), "bad_date")
        )

    rows = _rows(items, reason, on_bad)
    return rows.select(
        F.col("a.id").alias("id"),
        F.col("ticker").alias("company_id"),
        F.col("a.body").alias("title"),
        F.lit("").alias("summary"),
        F.lit(source).alias("source"),
        F.concat(F.lit(url), F.col("a.id")).alias("url"),
        iso_to_ms(F.col("a.created_at")).alias("published_at"),
        "pos",
        "reason",
    )


BAR_FEED = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("ts", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("open", "high", "low", "close", "volume")],
])


def ingest_bars(raw: DataFrame, on_bad: str = "stop", poll: Sequence[str] = (), arrival: Sequence[str] = ()) -> DataFrame:
    """Price-feed rows (ticker, ISO ts, open, high, low, close, volume as text) to bars.

    A volume must be a finite number and loses its fraction. Prices may be NaN, stored as
    NULL. With 'stop' the rows of a poll behind its first bad row are refused; a poll is a
    ticker plus the ``poll`` columns. Only (poll, first bad time) pairs are joined back, so
    good polls cost nothing extra. ``arrival`` names columns of the feed to keep: the order in
    which rows came.
    """
    def price(c: str) -> Column:
        value = F.col(c).try_cast("double")
        return F.when(~F.isnan(value), value).alias(c)

    number = F.col("volume").try_cast("double")
    ts = iso_to_ms("ts")
    bad = (
        F.when(ts.isNull(), "bad_ts")
        .when(F.greatest(*[F.col(c).try_cast("double").isNull().cast("int") for c in ("open", "high", "low", "close")]) == 1, "bad_price")
        .when(number.isNull() | F.isnan(number) | (F.abs(number) > F.lit(9.2e18)), "bad_volume")
    )
    rows = raw.select(
        F.col("ticker").alias("company_id"), *dict.fromkeys([*poll, *arrival]), ts.alias("ts_ms"),
        price("open"), price("high"), price("low"), price("close"),
        F.when(F.abs(number) <= F.lit(9.2e18), number).cast("long").alias("volume"),
        bad.alias("reason"),
    )
    if on_bad == "row":
        return rows.drop(*[c for c in poll if c not in arrival])
    if on_bad != "stop":
        raise ValueError(f"on_bad must be 'stop' or 'row', not {on_bad!r}")
    # A bad time stamp has no place in the order; it only refuses its own row.
    first = (
        rows.filter(F.col("reason").isNotNull() & F.col("ts_ms").isNotNull())
        .groupBy("company_id", *poll).agg(F.min("ts_ms").alias("_bad_ts"))
    )
    late = F.col("reason").isNull() & (F.col("ts_ms") > F.col("_bad_ts"))
    return (
        lookup(rows, first, ["company_id", *poll], "ts_ms", "left")
        .withColumn("reason", F.when(late, "after_bad").otherwise(F.col("reason")))
        .drop("_bad_ts", *[c for c in poll if c not in arrival])
    )
