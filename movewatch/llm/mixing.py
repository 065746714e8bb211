"""Mixing sources to target weights by capped water-filling.

A source is asked for its weight's share of all words, but no document is repeated more than
``most`` times: a source whose share is above that is clamped there, and what it can't give is
shared again by weight among the others, until no share is above its cap. Each round is one
aggregate over the table of sources that sends two sums to the driver.

A source's target is met by whole repetitions of all its documents and one partial one: documents are
put in a seeded order, and those whose words lie before the cut are taken once more. The one the cut
falls into gives only its words up to there, so each source comes out at its rounded target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewatch.llm.common import free_name
from movewatch.operators.joins import lookup
from movewatch.operators.ordered import positions, prefix_sums
from movewatch.session import materialized

SOURCE_PARTS = 16


def source_key(source: Column) -> Column:
    """A source as a text that is never null: ``=name``, or empty for null. So null is one source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def document_key(columns: Sequence[Column], seed: int) -> Column:
    """A seeded order key, 32 hex digits, from the values of some columns."""
    values = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("\n", F.lit(str(seed)), *values))


def targets(totals: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """``totals`` (_source, total) with weight and target.

    Sources by code point, null last, are given the weights in turn. An input without words has targets of 0.
    """
    last_null = [(F.col("_source") == "").asc(), F.col("_source").asc()]
    parted = materialized(
        totals.repartitionByRange(SOURCE_PARTS, *last_null).withColumn("_part", F.spark_partition_id()), "mix-sources"
    )
    rank = positions(parted, [], last_null, F.col("_part"), "rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
    weighted = materialized(rank.select("_source", "total", weight.alias("weight")), "mix-weights")
    cap = F.col("total") * F.lit(float(most))
    words = weighted.agg(F.sum("total")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        full = cap <= F.lit(level) * F.col("weight") if clamped >= 0 else F.lit(False)
        given, free, count = weighted.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count_if(full),
        ).first()
        if count == clamped:
            break
        level, clamped = (words - given) / free if free else float("inf"), count
    target = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.least(cap, F.lit(level) * F.col("weight")))
    return weighted.withColumn("target", target)


def mix(
    df: DataFrame,
    size: Column,
    weights: Sequence[float],
    most: float = 3.0,
    seed: int = 42,
    source: str = "source",
    identity: Sequence[Column] = (),
) -> DataFrame:
    """``df`` with size, source_size, target (its source's) and taken: the words the mix takes of each row.

    ``identity`` are the columns that tell documents apart, hashed with the seed for the order. Rows that
    agree in them and in source and size are treated alike: each gets an equal part, rounded down, of what they
    get together. Documents without words take 0. Null sources are one source. Columns called
    size, source_size, target or taken are replaced. An empty table gives an empty one.
    """
    name = {c: free_name(df, c) for c in ("_source", "_key")}
    base = df.drop("source_size", "target", "taken").withColumns(
        {name["_source"]: source_key(F.col(source)), name["_key"]: document_key(identity, seed), "size": size}
    )
    units = materialized(
        base.groupBy(F.col(name["_source"]).alias("_source"), F.col(name["_key"]).alias("_key"), "size").agg(F.count("*").alias("copies")),
        "mix-units",
    )
    totals = units.groupBy("_source").agg(F.sum(F.col("size") * F.col("copies")).alias("total"))
    plan = targets(totals, weights, most)
    before = prefix_sums(
        units, ["_source"], ["_key", "size"], F.substring("_key", 1, 4), {"before": F.col("size") * F.col("copies")}
    )
    goal = F.round("target").cast("long")
    whole = F.when(F.col("total") > 0, F.floor(goal / F.col("total"))).otherwise(F.lit(0)).cast("long")
    rest = goal - whole * F.col("total") - F.col("before")
    part = F.least(F.greatest(rest, F.lit(0).cast("long")), F.col("size") * F.col("copies"))
    shares = lookup(before, plan, ["_source"], "_key").select(
        F.col("_source").alias(name["_source"]),
        F.col("_key").alias(name["_key"]),
        "size",
        F.col("total").alias("source_size"),
        "target",
        (whole * F.col("size") + F.floor(part / F.col("copies"))).cast("long").alias("taken"),
    )
    return base.join(shares, [name["_source"], name["_key"], "size"]).drop(*name.values())


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix as rows: each document as often as it is taken, a partial copy counting as whole from half on."""
    part = F.col("taken") % F.greatest("size", F.lit(1))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size")) + (part * 2 >= F.col("size")).cast("int") * (part > 0).cast("int")).otherwise(F.lit(0))
    copy = free_name(mixed, "_copy")
    rows = mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return rows.drop(copy, "size", "source_size", "target", "taken")
