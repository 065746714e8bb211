"""Writes: insert-or-ignore, seeding, scoped replace and stored findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movewatch import schemas
from movewatch.functions.scalar import decode_finding, encode_finding
from movewatch.operators.joins import lookup
from movewatch.operators.ordered import top_n
from movewatch.session import materialized
from movewatch.sources import key_index

BAR_KEYS = ("company_id", "ts_ms")
ITEM_KEYS = ("id",)
REQUIRED = {
    "bar": ("company_id", "ts_ms"),
    "news": ("id", "company_id", "headline"),
    "discussion": ("id", "company_id", "title"),
    "company": ("company_id", "name"),
}


def null_in(columns: Sequence[str]) -> Column:
    return F.expr(" OR ".join(f"{c} IS NULL" for c in columns))


def unusable(new: DataFrame, kind: str) -> DataFrame:
    """The rows that lack a key or a required value, with the first such column as ``reason``."""
    needed = dict.fromkeys([*_KEYS[kind], *REQUIRED.get(kind, ())])
    first = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"null:{c}")) for c in needed])
    return new.withColumn("reason", first).filter(F.col("reason").isNotNull())


def append_new(
    new: DataFrame,
    existing: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    required: Sequence[str] = (),
) -> DataFrame:
    """The rows of ``new`` to append: first per key, key not stored yet, required set.

    Stored rows are never changed. Copies of a key are cut to one per map task before the
    shuffle, and only the key columns of the stored table are read. Running it again on
    what it already appended yields nothing, so a repeated batch is harmless. Rows that lack a
    key or a required value are not appended; ``unusable`` has them.
    """
    usable = new.filter(~null_in([*keys, *required]))
    first = top_n(usable, keys, order, 1)
    return first.join(existing.select(*keys), list(keys), "left_anti").select(*new.columns)


def first_of(new: DataFrame, kind: str, order: Sequence[Column]) -> DataFrame:
    """The usable rows of a batch, first per key."""
    keys = _KEYS[kind]
    return top_n(new.filter(~null_in([*keys, *REQUIRED.get(kind, ())])), keys, order, 1)


def seed_missing(seed: DataFrame, existing: DataFrame) -> DataFrame:
    """Companies of a fixed list that are not stored yet."""
    return append_new(seed, existing, ["company_id"], [F.asc("name")], REQUIRED["company"])


def replace_scope(new: DataFrame, existing: DataFrame, scope: DataFrame, col: str = "company_id") -> DataFrame:
    """The table after deleting every row in scope and inserting ``new``.

    Rows outside the scope stay as they are; running it again changes nothing.
    """
    outside = lookup(existing, scope.select(col), [col], F.struct(*existing.columns), "left_anti")
    return outside.select(*existing.columns).unionByName(new)


def finding_rows(
    findings: DataFrame,
    created_at: int | Column,
    iterations: Column | None = None,
    cost_usd: Column | None = None,
) -> DataFrame:
    """Validated findings as stored rows.

    The id has the form of a UUID but comes from (company, creation time, hypothesis), so a
    task or batch that is run again writes the same id.
    """
    created = F.lit(created_at) if isinstance(created_at, int) else created_at
    stamped = findings.withColumn("created_at", created.cast("long"))
    h = F.md5(F.concat_ws("|", "company_id", F.col("created_at").cast("string"), "hypothesis"))
    parts = [F.substring(h, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return stamped.select(
        F.concat_ws("-", *parts).alias("id"),
        "company_id",
        "created_at",
        "trigger",
        "primary_driver",
        "hypothesis",
        "evidence",
        "confidence",
        "needs_human_review",
        (iterations if iterations is not None else F.lit(0)).cast("long").alias("iterations"),
        (cost_usd if cost_usd is not None else F.lit(0.0)).cast("double").alias("cost_usd"),
        *[c for c in ("trigger_json", "evidence_json") if c in findings.columns],
    )


# --- tables on disk ---------------------------------------------------------

_TIME = {"bar": "ts_ms", "news": "published_at", "discussion": "published_at", "finding": "created_at"}
_STORED = {
    "bar": schemas.BAR,
    "news": schemas.NEWS,
    "discussion": schemas.DISCUSSION,
    "finding": schemas.STORED_FINDING,
}
_KEYS = {"bar": BAR_KEYS, "news": ITEM_KEYS, "discussion": ITEM_KEYS, "finding": ITEM_KEYS}


def _with_day(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("day", F.to_date(F.timestamp_millis(_TIME[kind])))


def open_table(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A stored table, one folder per day; made empty when it is not there yet."""
    schema = T.StructType([*_STORED[kind].fields, T.StructField("day", T.DateType())])
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("day").parquet(path)
    return spark.read.schema(schema).parquet(path)


def stored_columns(kind: str) -> list[str]:
    return _STORED[kind].names


def append_table(new: DataFrame, kind: str, path: str, order: Sequence[Column]) -> None:
    """Insert-or-ignore into a stored table; columns the table does not have only order.

    A bar's key fixes its day, so only the folders of the days in ``new`` are read back; the
    list of days is short by nature. Ids of other tables may come back with another date, so
    these tables have an index of their ids (``path + '_ids'``) and no folder is read back.
    """
    stored = open_table(new.sparkSession, kind, path)
    placed = _with_day(new, kind)
    if kind != "bar":
        _append_by_index(placed, kind, path, order)
        return
    fresh = append_new(placed, _on_days(stored, placed), _KEYS[kind], order, REQUIRED.get(kind, ()))
    fresh.select(*stored_columns(kind), "day").write.mode("append").partitionBy("day").parquet(path)


def _on_days(stored: DataFrame, rows: DataFrame) -> DataFrame:
    days = [r["day"] for r in rows.select("day").distinct().collect()]
    return stored.filter(F.col("day").isin(days)) if days else stored.limit(0)


def _append_by_index(placed: DataFrame, kind: str, path: str, order: Sequence[Column]) -> None:
    """Append the rows whose id the table's index lacks.

    The rows wait in a folder of their own while index and table are written. What is found there at the next
    append stems from a run that was cut off: it is finished first, from the folders of the rows' days.
    """
    spark = placed.sparkSession
    index, waiting = f"{path}_ids", f"{path}_waiting"
    columns = [*stored_columns(kind), "day"]
    schema = T.StructType([*_STORED[kind].fields, T.StructField("day", T.DateType())])
    spark.createDataFrame([], schema).write.mode("ignore").parquet(waiting)
    left = spark.read.schema(schema).parquet(waiting)
    if not left.isEmpty():
        missing = left.join(_on_days(open_table(spark, kind, path), left).select("id"), "id", "left_anti")
        _store(missing.select(*columns), left, index, path)
    elif not _exists(spark, index):
        key_index.add(open_table(spark, kind, path).select(F.col("id").alias("key")), index)  # new, or from before the index
    rows = first_of(placed, kind, order)
    stored = key_index.known(rows.select(F.col("id").alias("key")), index).withColumnRenamed("key", "id")
    rows.join(stored, "id", "left_anti").select(*columns).write.mode("overwrite").parquet(waiting)
    fresh = spark.read.schema(schema).parquet(waiting)
    _store(fresh, fresh, index, path)
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(waiting)


def _store(rows: DataFrame, indexed: DataFrame, index: str, path: str) -> None:
    key_index.add(indexed.select(F.col("id").alias("key")), index)
    rows.write.mode("append").partitionBy("day").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def write_findings(rows: DataFrame, path: str) -> None:
    """Store finding rows with trigger and evidence as JSON text, ignoring ids already there."""
    append_table(encode_finding(rows), "finding", path, [F.asc("company_id")])


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Stored findings with their nested fields again."""
    return decode_finding(open_table(spark, "finding", path)).drop("day")


def write_cycle(rows: DataFrame, path: str, cycle: int) -> None:
    """Store the findings of one scan cycle as a folder of their own; written again, it replaces itself."""
    encode_finding(rows).select(*stored_columns("finding")).write.mode("overwrite").parquet(f"{path}/cycle={cycle}")


def read_cycles(spark: SparkSession, path: str) -> DataFrame:
    """The findings of all cycles, with ``cycle``."""
    schema = T.StructType([*schemas.STORED_FINDING.fields, T.StructField("cycle", T.LongType())])
    return decode_finding(spark.read.schema(schema).option("basePath", path).parquet(path))


def latest_cycle(spark: SparkSession, path: str) -> DataFrame:
    """The findings of the last cycle: what holds now."""
    cycles = read_cycles(spark, path)
    return cycles.filter(F.col("cycle") == cycles.agg(F.max("cycle")).scalar()).drop("cycle")


def replace_stored(new: DataFrame, kind: str, path: str, scope: DataFrame) -> None:
    """``replace_scope`` on a stored table: all rows of the companies in ``scope``, on every day, give way to ``new``.

    Only the days that hold such rows, or get new ones, are written again, each as a whole and in one
    overwrite. Running it again changes nothing.
    """
    spark = new.sparkSession
    stored = open_table(spark, kind, path)
    placed = _with_day(new.select(*stored_columns(kind)), kind)
    touched = lookup(stored, scope.select("company_id").distinct(), ["company_id"], _TIME[kind], "left_semi")
    days = materialized(touched.select("day").unionByName(placed.select("day")).distinct(), "days")
    kept = replace_scope(placed, lookup(stored, days, ["day"], _TIME[kind], "left_semi").select(*placed.columns), scope)
    staged = materialized(kept, "replace")  # a table can't be read and overwritten in one job
    gone = days.join(staged.select("day").distinct(), "day", "left_anti")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for row in gone.toLocalIterator():  # days that have no rows left
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={row['day']}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
