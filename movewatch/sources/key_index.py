"""A stored index of the keys of a table, so that a batch finds what is stored without reading all of it.

Keys are dealt into buckets by hash, one folder each. A bucket has its keys and a Bloom filter, kept as rows (word, bits) that
are combined by OR, so a batch adds rows and changes none. Looking keys up opens the filters of the buckets the batch
falls into, and of these only the keys of buckets where some filter says maybe. The driver sees bucket numbers only.

``buckets`` and ``words`` (64 bits each, a filter) are fixed when an index is made and read back from it. With 10 bits a key
a filter passes one unknown key in 100. A fuller one passes more: it costs reading and never changes what is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movewatch.session import materialized

BUCKETS, WORDS, PROBES = 64, 4096, 5
_SPEC = "buckets int, words int, probes int"
_KEYS = "key string, bucket int"
_BITS = "word int, bits long, bucket int"


def create(spark: SparkSession, path: str, buckets: int = BUCKETS, words: int = WORDS, probes: int = PROBES) -> None:
    """Make an index, unless there is one."""
    spark.createDataFrame([(buckets, words, probes)], _SPEC).coalesce(1).write.mode("ignore").parquet(f"{path}/spec")


def _spec(spark: SparkSession, path: str) -> tuple[int, int, int]:
    create(spark, path)
    return tuple(spark.read.schema(_SPEC).parquet(f"{path}/spec").first())


def _part(spark: SparkSession, path: str, part: str, schema: str, buckets: list[int]) -> DataFrame:
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket").parquet(f"{path}/{part}")
    rows = spark.read.schema(schema).parquet(f"{path}/{part}")
    return rows.filter(F.col("bucket").isin(buckets)) if buckets else rows.limit(0)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(buckets)).cast("int")


def _probes(words: int, probes: int) -> Column:
    """(word, mask) of each bit a key sets."""
    one = "struct(cast(pmod(shiftrightunsigned(xxhash64({i}, key), 6), {words}) AS int) AS word, shiftleft(1L, cast(xxhash64({i}, key) & 63 AS int)) AS mask)"
    return F.array(*[F.expr(one.format(i=100 + i, words=words)) for i in range(probes)])


def _numbers(rows: DataFrame) -> list[int]:
    """The buckets that rows are in: at most as many numbers as there are buckets."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def add(keys: DataFrame, path: str) -> None:
    """Add the keys (one string column, ``key``). Adding a key again changes nothing that a look-up finds."""
    spark = keys.sparkSession
    buckets, words, probes = _spec(spark, path)
    placed = materialized(keys.filter(F.col("key").isNotNull()).select("key", _bucket(buckets).alias("bucket")), "index-keys")
    bits = placed.select("bucket", F.explode(_probes(words, probes)).alias("p")).groupBy("bucket", "p.word").agg(F.bit_or("p.mask").alias("bits"))
    bits.repartition("bucket").select("word", "bits", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/bits")
    placed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/keys")


def maybe(keys: DataFrame, path: str) -> DataFrame:
    """(key, bucket) of the different keys that the filters pass; only the batch's buckets are opened."""
    spark = keys.sparkSession
    buckets, words, probes = _spec(spark, path)
    asked = materialized(keys.filter(F.col("key").isNotNull()).select("key").distinct().withColumn("bucket", _bucket(buckets)), "index-asked")
    stored = _part(spark, path, "bits", _BITS, _numbers(asked)).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    asks = asked.select("key", "bucket", F.explode(F.array_distinct(_probes(words, probes))).alias("p")).select("key", "bucket", "p.word", "p.mask")
    lacking = asks.join(stored, ["bucket", "word"], "left").filter(F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == 0, F.lit(True)))
    return asked.join(lacking.select("key").distinct(), "key", "left_anti")


def known(keys: DataFrame, path: str) -> DataFrame:
    """The different keys (column ``key``) that are in the index."""
    passed = materialized(maybe(keys, path), "index-maybe")
    stored = _part(keys.sparkSession, path, "keys", _KEYS, _numbers(passed))
    return passed.join(stored, ["bucket", "key"], "left_semi").select("key")


def compact(spark: SparkSession, path: str, words: int | None = None) -> None:
    """Write the index again with one file a bucket, each key once and, if ``words`` is given, filters of that size.

    Goes to a folder beside and takes the old one's place at the end; a stop in between leaves the index as it was.
    """
    buckets, old, probes = _spec(spark, path)
    every = list(range(buckets))
    fresh = f"{path}_compact"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(fresh), True)
    create(spark, fresh, buckets, words or old, probes)
    add(_part(spark, path, "keys", _KEYS, every).select("key").distinct(), fresh)
    fs.delete(fs_path(f"{path}_before"), True)
    fs.rename(fs_path(path), fs_path(f"{path}_before"))
    fs.rename(fs_path(fresh), fs_path(path))
    fs.delete(fs_path(f"{path}_before"), True)
