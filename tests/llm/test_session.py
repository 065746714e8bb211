"""Corpus queries leave the caller's session as it was."""

import corpus_pipeline
from movewatch.llm import queries


def test_settings_stay(spark):
    before = dict(spark.sql("SET").collect())
    for name in ("op1_suffix_array_dedup", "op3_decontaminate", "op4_nearest_neighbours", "op6_quality", "op7_simhash_groups", "op10_main_text", "op12_fill_in_middle"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert dict(spark.sql("SET").collect()) == before
