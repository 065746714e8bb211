"""The given tables seen as companies, bars, signals, finding texts, traces and usage.

None of the given tables is a price table, so these views define one reading of them.
``plans.catalog`` holds the same views as SQL for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movewatch.functions.scalar import once
from movewatch.operators.findings import validate_findings
from movewatch.operators.ordered import positions, time_bucket
from movewatch.session import configure

AS_OF_MS = 1_706_659_200_000  # 2024-01-31T00:00:00Z, the end of the event month
FEED_SIZE = 8  # articles a news or discussion poll returns
NEWS_LEAST = 4  # news items that make news the driver, so that all four drivers occur
RUN_STEPS = 12  # steps recorded per run; the loop itself stops at its own budget
ID_BUCKET = 4096  # events per bucket when numbering a company's events in id order

# Columns of the given tables, so that reading them needs no look into a file first.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Finding text of a signup event, as SQL both engines read: FINDING_BODY from event_id,
# user_id and k, then FINDING_TEXT from event_id and body. event_id % 40 picks which rule
# the text breaks, if any.
_M = "(event_id % 40)"
_DRIVER = "CASE k % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'discussion' WHEN 2 THEN 'sector' ELSE 'unexplained' END"
_CONFIDENCE = "CASE k % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'medium' ELSE 'low' END"
_K = "cast(k AS string)"
_U = "cast(user_id AS string)"
_NAME = f"'Customer#' || lpad({_K}, 9, '0')"
_EVIDENCE = f"""CASE
  WHEN k % 4 = 0 THEN '[{{"type":"news","ref":"Item ' || {_K} || '","why":"same session"}}]'
  WHEN k % 4 = 1 THEN '[{{"type":"discussion","ref":"board","why":"busy"}}]'
  WHEN k % 4 = 2 THEN '[{{"type":"sector","ref":"' || {_NAME} || '","why":"moved alike"}},{{"type":"price","ref":"' || {_U} || '","why":"large"}}]'
  WHEN k % 8 = 7 THEN '[{{"type":"price","ref":"' || {_U} || '","why":"no cause, see ' || {_NAME} || '."}}]'
  WHEN k % 16 = 3 THEN '[{{"type":"news","ref":"Item ' || {_K} || '","why":"stale"}}]'
  ELSE '[]' END"""
FINDING_BODY = f"""'{{' || concat_ws(',',
  CASE {_M} WHEN 1 THEN NULL WHEN 8 THEN '"ticker":7' ELSE '"ticker":"' || {_U} || '"' END,
  CASE {_M} WHEN 2 THEN NULL WHEN 9 THEN '"trigger":[]'
    WHEN 31 THEN '"trigger":{{"z_score":"high","note":{{"k":' || {_K} || '}},"direction":"up"}}'
    ELSE '"trigger":{{"z_score":-' || {_K} || '.5,"volume_ratio":3,"direction":"down","latest_return_pct":-4.25}}' END,
  CASE WHEN {_M} = 3 THEN NULL WHEN {_M} = 10 THEN '"hypothesis":null'
    WHEN k % 9 = 0 THEN '"hypothesis":"Holders may SELL after item ' || {_K} || '"'
    WHEN k % 9 = 1 THEN '"hypothesis":"Nobody recommends item ' || {_K} || '"'
    ELSE '"hypothesis":"Moved with item ' || {_K} || '"' END,
  CASE {_M} WHEN 4 THEN NULL WHEN 11 THEN '"primary_driver":3' WHEN 17 THEN '"primary_driver":"macro"'
    WHEN 22 THEN '"primary_driver":"macro"' ELSE '"primary_driver":"' || {_DRIVER} || '"' END,
  CASE {_M} WHEN 5 THEN NULL WHEN 12 THEN '"evidence":{{}}'
    WHEN 32 THEN '"evidence":["A line of text ' || {_K} || '",{{"type":"news","ref":"Item ' || {_K} || '","seen":true}},7]' ELSE '"evidence":' || {_EVIDENCE} END,
  CASE {_M} WHEN 6 THEN NULL WHEN 13 THEN '"confidence":true' WHEN 18 THEN '"confidence":"certain"'
    WHEN 19 THEN '"confidence":"low"' ELSE '"confidence":"' || {_CONFIDENCE} || '"' END,
  CASE WHEN {_M} = 7 THEN NULL WHEN {_M} = 14 THEN '"needs_human_review":1'
    WHEN {_M} = 20 THEN '"needs_human_review":"true"' WHEN {_M} = 19 THEN '"needs_human_review":false'
    WHEN k % 4 = 3 AND k % 10 <> 7 THEN '"needs_human_review":true' ELSE '"needs_human_review":false' END,
  CASE {_M} WHEN 15 THEN NULL WHEN 16 THEN '"advice":"wait"' WHEN 21 THEN '"advice":false'
    WHEN 22 THEN '"advice":"wait"' ELSE '"advice":null' END
) || '}}'"""
FINDING_TEXT = f"""CASE {_M}
  WHEN 23 THEN substring(body, 1, 40)
  WHEN 24 THEN '[' || body || ']'
  WHEN 25 THEN 'Here it is: ' || body
  WHEN 26 THEN '```json' || chr(10) || body || chr(10) || '```'
  WHEN 27 THEN '  ```' || chr(10) || body || chr(10) || '```  ' || chr(10)
  WHEN 28 THEN ''
  WHEN 29 THEN 'null'
  ELSE body END"""


def with_finding_text(df: DataFrame, wanted: Column) -> DataFrame:
    """Adds the finding text of the rows where ``wanted`` holds."""
    with_body = once(df, body=F.when(wanted, F.expr(FINDING_BODY)))
    return once(with_body, text=F.when(wanted, F.expr(FINDING_TEXT))).drop("body")


class Market:
    """Lazy views over one folder of the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """Events with epoch ms, the number k of props and the company id."""
        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        return self.table("events").withColumns({
            "ms": ms,
            "k": F.get_json_object("props", "$.k").cast("int"),
            "company_id": F.col("user_id").cast("string"),
        })

    @cached_property
    def companies(self) -> DataFrame:
        users = self.table("events").select(F.col("user_id").alias("c_custkey")).distinct()
        return self.table("customer").join(users, "c_custkey", "left_semi").select(
            F.col("c_custkey").cast("string").alias("company_id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("sector"),
        )

    @cached_property
    def gappy_companies(self) -> DataFrame:
        """Companies where one sector is missing, for the NULL rules of peers."""
        sector = F.when(F.col("sector") != "MACHINERY", F.col("sector"))
        return self.companies.withColumn("sector", sector)

    @cached_property
    def bars(self) -> DataFrame:
        """Hourly bars of event values, one company per user."""
        hour = (F.floor(F.col("ms") / F.lit(3_600_000)) * F.lit(3_600_000)).cast("long")
        return self.events.groupBy("user_id", hour.alias("ts_ms")).agg(
            F.min_by("value", "event_id").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.count(F.lit(1)).alias("volume"),
        ).select(F.col("user_id").cast("string").alias("company_id"), "ts_ms", "open", "high", "low", "close", "volume")

    @cached_property
    def ticks(self) -> DataFrame:
        """One bar per event."""
        v = F.col("value")
        return self.events.select(
            "company_id", F.col("ms").alias("ts_ms"), v.alias("open"), v.alias("high"), v.alias("low"),
            v.alias("close"), F.lit(1).cast("long").alias("volume"),
        )

    @cached_property
    def gap_ticks(self) -> DataFrame:
        """Ticks of which some have no close, or one that is not a number."""
        second = F.floor(F.col("ts_ms") / F.lit(1000))
        close = F.when(second % 131 == 5, F.lit(float("nan"))).when(second % 137 != 3, F.col("close"))
        return self.ticks.withColumn("close", close)

    @cached_property
    def ship_bars(self) -> DataFrame:
        """Daily bars of unit prices, one company per supplier."""
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return self.table("lineitem").groupBy("l_suppkey", "l_shipdate").agg(
            F.avg(price).alias("close"), F.sum("l_quantity").cast("long").alias("volume")
        ).select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("company_id"),
            F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"),
            "close", "volume",
        )

    def _items(self, event_type: str, text: str, prefix: str) -> DataFrame:
        e = self.events.filter(F.col("event_type") == event_type)
        key = F.col("event_id").cast("string")
        k = F.col("k").cast("string")
        return e.select(
            key.alias("id"),
            "company_id",
            F.concat(F.lit(prefix), k).alias(text),
            F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("about "), k)).alias("summary"),
            F.lit("wire" if text == "headline" else "board").alias("source"),
            F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("https://example.org/"), key)).alias("url"),
            F.col("ms").alias("published_at"),
        )

    @cached_property
    def news(self) -> DataFrame:
        return self._items("error", "headline", "Item ")

    @cached_property
    def discussion(self) -> DataFrame:
        return self._items("click", "title", "Post ")

    def _dealt(self, events: DataFrame, size: int) -> DataFrame:
        """A company's events in id order, dealt into groups of ``size``: group_no and n."""
        placed = positions(events, ["company_id"], ["event_id"], time_bucket("event_id", ID_BUCKET))
        group_no = F.floor(F.col("position") / F.lit(size)).cast("string")
        return placed.withColumn("group_no", group_no).withColumn("n", (F.col("position") % size).cast("int"))

    def _polls(self, event_type: str, item: Column) -> DataFrame:
        """All events of a type as polls of FEED_SIZE items each, oldest first."""
        dealt = self._dealt(self.events.filter(F.col("event_type") == event_type), FEED_SIZE)
        return dealt.groupBy("company_id", "group_no").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def _iso(self, good: Column) -> Column:
        text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return F.when(good, text).otherwise("n/a")

    @cached_property
    def news_polls(self) -> DataFrame:
        """(ticker, payload): article ids repeat over tickers, some lack URL or date."""
        half = F.floor(F.col("event_id") / F.lit(2)).cast("string")
        url = F.when(F.col("event_id") % 7 != 3, F.concat(F.lit("https://example.org/"), half)).otherwise("")
        article = F.struct(
            "n",
            half.alias("id"),
            F.struct(
                F.concat(F.lit("Item "), F.col("k").cast("string")).alias("title"),
                self._iso(F.col("event_id") % 11 != 5).alias("pubDate"),
                F.struct(url.alias("url")).alias("canonicalUrl"),
                F.struct(F.lit("wire").alias("displayName")).alias("provider"),
            ).alias("content"),
        )
        return self._polls("error", article).select(F.col("company_id").alias("ticker"), F.to_json("items").alias("payload"))

    @cached_property
    def discussion_polls(self) -> DataFrame:
        message = F.struct(
            "n",
            F.col("event_id").alias("id"),
            F.concat(F.lit("Post "), F.col("k").cast("string")).alias("body"),
            self._iso(F.col("event_id") % 11 != 5).alias("created_at"),
        )
        payload = F.to_json(F.struct(F.col("items").alias("messages")))
        return self._polls("click", message).select(F.col("company_id").alias("ticker"), payload.alias("payload"))

    @cached_property
    def bar_feed(self) -> DataFrame:
        """Event rows as text price rows, polled per company and day; some are broken."""
        value = F.col("value").cast("string")
        ts = self._iso(F.col("event_id") % 89 != 1)
        volume = F.when(F.col("event_id") % 23 != 2, F.col("k").cast("string")).otherwise("n/a")
        return self.events.select(
            F.col("company_id").alias("ticker"), F.floor(F.col("ms") / F.lit(86_400_000)).alias("poll_day"),
            ts.alias("ts"), *[value.alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"), "event_id",
        )

    @cached_property
    def finding_texts(self) -> DataFrame:
        signup = self.events.filter(F.col("event_type") == "signup")
        return with_finding_text(signup, F.lit(True)).select("event_id", "company_id", "ms", "text")

    @cached_property
    def trace(self) -> DataFrame:
        """All events as runs of RUN_STEPS steps per company; a signup event is a final answer,
        the others are tool calls."""
        numbered = self._dealt(self.events, RUN_STEPS).withColumns({
            "run_id": F.concat_ws("-", "company_id", "group_no"), "step": F.col("n") + 1,
        })
        end = F.col("event_type") == "signup"
        tool = (
            F.when(F.col("k") % 13 == 0, "get_weather")
            .when(F.col("event_type") == "error", "get_news")
            .when(F.col("event_type") == "click", "get_discussion")
            .when(F.col("event_type") == "view", "get_price_movement")
            .otherwise("get_related_companies")
        )
        ticker = F.when(F.col("k") % 11 != 0, F.when(F.col("k") % 2 == 0, F.col("company_id")).otherwise(F.col("k").cast("string")))
        days = F.when(F.col("k") % 5 == 0, "ten").when(F.col("k") % 5 >= 3, F.col("k").cast("string"))
        given = F.map_filter(
            F.create_map(F.lit("ticker"), ticker, F.lit("window_days"), days), lambda _, v: v.isNotNull()
        )
        return with_finding_text(numbered, end).select(
            "run_id", F.col("company_id").alias("ticker"), "step",
            F.when(end, "end").otherwise("tool_use").alias("stop_reason"),
            "text",
            F.when(~end, F.array(F.struct(tool.alias("name"), given.alias("args")))).alias("tool_calls"),
        )

    @cached_property
    def scenarios(self) -> DataFrame:
        """One scenario per company; the number of the company picks which."""
        kind = F.col("company_id").cast("long") % 3
        return self.companies.select(
            F.col("company_id").alias("ticker"),
            F.when(kind == 0, "news").when(kind == 1, "sector").otherwise("unexplained").alias("expected_driver"),
            F.when(kind == 0, F.array(F.lit("high")))
            .when(kind == 1, F.array(F.lit("medium"), F.lit("high")))
            .otherwise(F.array(F.lit("low"))).alias("expected_band"),
            (kind == 2).alias("expected_review"),
            F.when(kind == 0, "news").when(kind == 1, "peer").otherwise("exhaustive").alias("check_name"),
        )

    @cached_property
    def findings(self) -> DataFrame:
        """Stored findings: the valid finding texts, created at the time of their event."""
        valid = validate_findings(self.finding_texts).filter(F.col("reason").isNull())
        return valid.select(
            F.col("event_id").cast("string").alias("id"), "company_id", F.col("ms").alias("created_at"),
            "trigger", "primary_driver",
            # fewer distinct texts, so that findings repeat
            F.concat(F.lit("Moved: "), "primary_driver", F.lit(" "), (F.col("event_id") % 2).cast("string")).alias("hypothesis"),
            "evidence", "confidence", "needs_human_review", "trigger_json", "evidence_json",
            (F.col("event_id") % 8 + 1).alias("iterations"),
            ((F.col("event_id") % 100) / F.lit(1000.0)).alias("cost_usd"),
        )

    @cached_property
    def usage(self) -> DataFrame:
        """Model calls from conversation turns: text length stands for tokens."""
        chars = F.length("text").cast("long")
        output = F.col("role") == "assistant"
        zero = F.lit(0).cast("long")
        return self.table("conversations").select(
            "conv_id", "turn",
            (F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"),
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("call_id"),
            F.when(output, zero).otherwise(chars).alias("input_tokens"),
            F.when(output, chars).otherwise(zero).alias("output_tokens"),
        )
