"""Ordered computations that hold when one key has a large share of the rows.

A window over a whole key puts that key in one task. The helpers here cut each key
into buckets that follow the order, work inside (key, bucket), and carry a small
per-bucket summary from bucket to bucket. The only window over a whole key runs on
the summary, which has one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_B = "_bucket"


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key.

    The ``row_number <= n`` shape lets Spark cut each key to n rows per map task
    before the shuffle, so a hot key sends n rows per task and not all it has.
    """
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def time_bucket(ts: Column | str, width_ms: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(ts / F.lit(width_ms)).cast("long")


def split_points(df: DataFrame, column: str, buckets: int) -> list:
    """At most ``buckets - 1`` ascending values that cut the column into even shares.

    One aggregate whose answer is a short list of numbers. The points only balance
    the work; results do not depend on where they fall.
    """
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(column), shares, F.lit(1000)).alias("points")).first()
    return sorted(set(row["points"] or []))


def range_bucket(column: Column | str, points: Sequence) -> Column:
    """Number of split points below the value: a bucket that follows the order."""
    column = F.col(column) if isinstance(column, str) else column
    total = F.lit(0)
    for p in points:
        total = total + F.when(column > F.lit(p), 1).otherwise(0)
    return total


def lag_by_bucket(
    df: DataFrame, keys: Sequence[str], order: str, value: str, bucket: Column, out: str
) -> DataFrame:
    """Previous row's value within each key, without a window over the whole key."""
    keys = list(keys)
    bucketed = df.withColumn(_B, bucket)
    inside = Window.partitionBy(*keys, _B).orderBy(order)
    tails = bucketed.groupBy(*keys, _B).agg(F.max_by(value, order).alias("_closing"))
    across = Window.partitionBy(*keys).orderBy(_B)
    heads = tails.withColumn("_carried", F.lag("_closing").over(across)).drop("_closing")
    return (
        bucketed.withColumn("_opens", F.row_number().over(inside) == 1)
        .withColumn("_lagged", F.lag(value).over(inside))
        .join(heads, [*keys, _B], "left")
        .withColumn(out, F.when(F.col("_opens"), F.col("_carried")).otherwise(F.col("_lagged")))
        .drop(_B, "_opens", "_lagged", "_carried")
    )


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """For each ``out: value``, the sum of value over the earlier rows of the key.

    ``bucket`` must not decrease along ``order``. With no keys the order is global.
    """
    keys = list(keys)
    values = {f"_v{i}": v for i, v in enumerate(sums.values())}
    names = list(sums)
    bucketed = df.withColumns({_B: bucket, **values})
    totals = bucketed.groupBy(*keys, _B).agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    across = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, _B, *[F.sum(f"_t{v}").over(across).alias(f"_o{v}") for v in values]
    )
    inside = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    out = bucketed.withColumns({f"_w{v}": F.sum(v).over(inside) for v in values})
    out = out.join(offsets, [*keys, _B], "left")
    out = out.withColumns({
        name: F.coalesce(F.col(f"_o{v}"), zero) + F.coalesce(F.col(f"_w{v}"), zero)
        for name, v in zip(names, values)
    })
    drop = [f"{p}{v}" for v in values for p in ("_o", "_w")]
    return out.drop(_B, *values, *drop)


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, out: str = "position"
) -> DataFrame:
    """0-based position of each row within its key."""
    return prefix_sums(df, keys, order, bucket, {out: F.lit(1).cast("long")})
