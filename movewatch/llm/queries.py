"""The registered queries of the corpus operators, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movewatch.llm import decontaminate, embedding_dedup, fill_middle, hard_negatives, html_text, mixing, neighbours, quality, sharding, simhash, substring_dedup, suffix_dedup, url_filter
from movewatch.llm.common import table, utf8_bytes, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MIX_WEIGHTS, MIX_MOST, MIX_SEED = (5, 2, 1), 3.0, 42
SHARDS = 8
QUALITY_LEAST = 0.3
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return register


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 200)


@query("op2_mix_sources", r"""
    WITH docs AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               md5('42' || chr(10) || coalesce('=' || doc_id, '') || chr(10) || coalesce('=' || md5(text), '')) AS key
        FROM documents
    ), totals AS (
        SELECT source, sum(size)::BIGINT AS total,
               [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight
        FROM docs GROUP BY source
    ), filled AS (
        SELECT *, 3.0 * total AS cap,
               coalesce(sum(3.0 * total) OVER before, 0) AS given,
               sum(weight) OVER (ORDER BY 3.0 * total / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
        FROM totals
        WINDOW before AS (ORDER BY 3.0 * total / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), level AS (  -- the first source, by cap for its weight, that the level of the rest doesn't reach
        SELECT arg_min(((SELECT sum(total) FROM totals) - given) / free, cap / weight) FILTER (cap / weight > ((SELECT sum(total) FROM totals) - given) / free) AS level
        FROM filled
    ), targets AS (
        SELECT source, total, CASE WHEN total = 0 THEN 0.0 ELSE least(3.0 * total, (SELECT level FROM level) * weight) END::DOUBLE AS target FROM totals
    ), ordered AS (
        SELECT docs.*, total, target, floor(target + 0.5)::BIGINT AS goal,
               coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
    )
    SELECT doc_id, size, total AS source_size, target,
           (CASE WHEN total = 0 THEN 0 ELSE goal // total * size + least(greatest(goal % total - before, 0), size) END)::BIGINT AS taken
    FROM ordered
""")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"), F.md5("text").alias("digest"))
    identity = [F.col("doc_id"), F.col("digest")]
    mixed = mixing.mix(docs, F.col("words"), MIX_WEIGHTS, MIX_MOST, MIX_SEED, identity=identity)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark"))


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, F.col("vec_id") % 20 == 0, k=20)


@query("op5_url_filter", r"""
    WITH parts AS (
        SELECT page_id,
               translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages
    ), rules(verdict, rhost, rpath) AS (
        VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
               ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
    ), judged AS (
        SELECT p.*, (SELECT rhost || rpath FROM rules
                     WHERE (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
                     ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule
        FROM parts p
    )
    SELECT page_id, host, path, rule,
           coalesce((SELECT verdict FROM rules WHERE rhost || rpath = rule), 'allow') AS verdict
    FROM judged
""")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.scored(docs, labels).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"),
    )


@query("op7_simhash_groups")
def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_later(table(spark, sf_dir, "documents").select("doc_id", "text"), 20)


@query("op9_shards")
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (utf8_bytes(text) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.assign(docs, SHARDS, ("doc_id", "text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op10_main_text")
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op11_embedding_dedup")
def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op12_fill_in_middle", r"""
    WITH docs AS (
        SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
               sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
        FROM documents
    ), drawn AS (
        SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
        FROM docs
    ), cut AS (
        SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn
    ), pieces AS (
        SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM cut
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM pieces
""")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


@query("op13_hard_negatives", r"""
    WITH vectors AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS own, list_inner_product(a.q, r.q)::BIGINT AS score
        FROM vectors a JOIN vectors r ON a.vec_id <> r.vec_id
        WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE own
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, p.positive_id,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
           n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.own
     AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
    QUALIFY rank <= 5
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)
