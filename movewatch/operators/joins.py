"""Joins of many rows to one row per key, safe for a key that holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread: str | Column,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """``facts`` joined to ``dim`` on ``keys``, each key cut into ``salts`` parts.

    ``spread`` is a column that differs between the rows of a key; its hash picks the part,
    so a task that is run again picks the same. The dim rows are copied to every part.
    Because the copies are shuffled for this join alone, adaptive execution may split a part
    that is still too large, which it cannot do where the dim is a per-key aggregate
    with the same partitioning. A dim that is small enough by measured size is broadcast as
    in any join. ``how`` may be inner, left, left_semi or left_anti: those that keep facts.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    part = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return facts.withColumn("_salt", part).join(copies, [*keys, "_salt"], how).drop("_salt")
