"""The company-signal graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from movewatch.operators.joins import lookup
from movewatch.operators.retrieval import latest_signals, ordered_peers

STAGGER_S = 0.05


def graph_nodes(
    companies: DataFrame, news: DataFrame, discussion: DataFrame, focus: DataFrame, k: int = 10
) -> DataFrame:
    """Company nodes, their newest news and posts, and the peers of the focused companies.

    ``focus`` (company_id) names the companies whose peers are drawn. ``ordinal`` counts
    news, then posts, then peers, from 0; ``delay_s`` is the reveal delay.
    """
    def child(df: DataFrame, kind: str, text: str) -> DataFrame:
        return latest_signals(df, k).select(
            F.concat("company_id", F.lit(f"-{kind}-"), "id").alias("node_id"),
            F.lit(kind).alias("node_type"),
            F.col("company_id").alias("parent_id"),
            F.col(text).alias("label"),
            F.col("id").alias("item_id"),
            (F.col("rank") - 1).cast("long").alias("place"),
        )

    known = companies.select(F.col("company_id").alias("parent_id"))
    news_nodes = child(news, "news", "headline")
    post_nodes = child(discussion, "discussion", "title")
    signals = news_nodes.unionByName(post_nodes).join(known, "parent_id", "left_semi")
    peer_nodes = ordered_peers(companies, focus).select(
        F.concat("company_id", F.lit("-related-"), "peer_id").alias("node_id"),
        F.lit("relatedCompany").alias("node_type"),
        F.col("company_id").alias("parent_id"),
        F.col("peer_name").alias("label"),
        F.col("peer_id").alias("item_id"),
        F.col("position").alias("place"),
    )
    # At most k news and k posts per company, so these counts are over small groups.
    counts = signals.groupBy("parent_id").agg(
        F.count_if(F.col("node_type") == "news").alias("n_news"), F.count(F.lit(1)).alias("n_signals")
    )
    children = signals.unionByName(peer_nodes)
    placed = lookup(children, counts, ["parent_id"], "node_id", "left").fillna(0, ["n_news", "n_signals"])
    offset = (
        F.when(F.col("node_type") == "discussion", F.col("n_news"))
        .when(F.col("node_type") == "relatedCompany", F.col("n_signals"))
        .otherwise(0)
    )
    children = placed.select(
        "node_id", "node_type", "parent_id", "label", "item_id", (F.col("place") + offset).alias("ordinal")
    )
    roots = companies.select(
        F.col("company_id").alias("node_id"),
        F.lit("company").alias("node_type"),
        F.lit(None).cast("string").alias("parent_id"),
        F.col("name").alias("label"),
        F.lit(None).cast("string").alias("item_id"),
        F.lit(None).cast("long").alias("ordinal"),
    )
    return roots.unionByName(children).withColumn("delay_s", F.col("ordinal") * F.lit(STAGGER_S))


def graph_edges(nodes: DataFrame) -> DataFrame:
    """One edge from each company to each of its children."""
    return nodes.filter(F.col("parent_id").isNotNull()).select(
        F.concat(F.lit("edge-"), "parent_id", F.lit("-"), "node_id").alias("edge_id"),
        F.col("parent_id").alias("src"),
        F.col("node_id").alias("dst"),
    )


def focus_nodes(nodes: DataFrame, company: str | None = None) -> DataFrame:
    """Adds ``dimmed``: true outside the selected company; false for all when none is."""
    if company is None:
        return nodes.withColumn("dimmed", F.lit(False))
    owner = F.coalesce("parent_id", "node_id")
    return nodes.withColumn("dimmed", owner != F.lit(company))


def focus_edges(edges: DataFrame, node: str | None = None) -> DataFrame:
    """Adds ``highlighted``: true for edges into the hovered node."""
    if node is None:
        return edges.withColumn("highlighted", F.lit(False))
    return edges.withColumn("highlighted", F.col("dst") == F.lit(node))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("node_id")
    # many edges start at one company: its end of the join is salted
    started = lookup(edges, ids.withColumnRenamed("node_id", "src"), ["src"], "dst", "left_semi")
    return started.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids removed from and added to the node set between two refreshes."""
    before, after = old.select("node_id").distinct(), new.select("node_id").distinct()
    removed = before.join(after, "node_id", "left_anti").withColumn("change", F.lit("removed"))
    added = after.join(before, "node_id", "left_anti").withColumn("change", F.lit("added"))
    return removed.unionByName(added)


# --- stored snapshots --------------------------------------------------------

BUCKETS = 64


def store_snapshot(nodes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store a node set in buckets by id, with a digest of each bucket that does not depend on the order of its rows."""
    spread = nodes.withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(buckets)).cast("int"))
    spread.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/nodes")
    stored = nodes.sparkSession.read.schema(spread.schema).parquet(f"{path}/nodes")
    row = F.struct(*[F.col(c) for c in nodes.columns])
    sums = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(20,0)")).alias(f"d{seed}") for seed in (1, 2)]
    digests = stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *sums)
    digests.coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")


def snapshot_diff(spark: SparkSession, old: str, new: str, nodes: T.StructType) -> DataFrame:
    """(node_id, change) between two stored snapshots of as many buckets: removed, added, or changed in some other column.

    The digests are compared first, a row a bucket; only buckets whose digests differ are opened, in both snapshots.
    """
    schema = T.StructType([*nodes.fields, T.StructField("bucket", T.IntegerType())])
    before, after = (spark.read.parquet(f"{path}/digests") for path in (old, new))
    other = before.join(after.toDF("bucket", "_n", "_d1", "_d2"), "bucket", "full").filter(
        ~(F.col("n").eqNullSafe(F.col("_n")) & F.col("d1").eqNullSafe(F.col("_d1")) & F.col("d2").eqNullSafe(F.col("_d2")))
    )
    buckets = sorted(r["bucket"] for r in other.select("bucket").collect())

    def opened(path: str, name: str) -> DataFrame:
        rows = spark.read.schema(schema).parquet(f"{path}/nodes")
        rows = rows.filter(F.col("bucket").isin(buckets)) if buckets else rows.limit(0)
        return rows.select("node_id", F.struct(*[F.col(c) for c in nodes.names]).alias(name))

    both = opened(old, "_old").join(opened(new, "_new"), "node_id", "full")
    change = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select("node_id", change.alias("change")).filter(F.col("change").isNotNull())
