"""Connected components of a distributed list of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movewatch.operators.joins import lookup
from movewatch.session import materialized


def local_roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0 up to ``size`` - 1, the smallest node each is linked to over any number of links."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            return root


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours, linked to the smallest node among it and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.filter(F.col("v") > F.col("u"))
    return lookup(larger, least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _fold(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and itself, linked to the smallest of them. ``u`` > ``v`` in all links."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    linked = lookup(links, least, ["u"], "v")
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) but the roots, which are the smallest of their components.

    Links may repeat, run either way, or join a node to itself. Rounds are logarithmic in the longest chain; each
    is written to the shared folder, so a lost executor costs one round at most. No group of links is ever
    gathered: the stars are aggregates and salted joins.
    """
    turned = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = materialized(turned, "links")
    seen = _digest(now)
    while seen[0]:
        now = materialized(_fold(_star(now)), "links")
        made = _digest(now)
        if made == seen:
            break
        seen = made
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
