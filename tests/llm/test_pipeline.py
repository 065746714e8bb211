"""The pipeline's stages one by one and together."""

import shutil
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from movewatch.llm import decontaminate
from tests.llm.test_simhash import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input rows, output rows) of every stage, by name."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for n, (name, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(n))
        stage(spark, docs, SF).write.parquet(path)
        result = spark.read.parquet(path)
        if n < len(pipeline.STAGES) - 1:
            assert result.columns == docs.columns and result.dtypes == docs.dtypes
        out[name] = (docs.collect(), result.collect())
        docs = result
    return out


def test_quality_keeps_good_documents(spark, stages):
    before, after = stages["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_groups_are_those_of_shingles(stages):
    before, after = stages["SimHash near-dedup"]
    assert {r.doc_id for r in after} == plain_kept([(r.doc_id, r.text) for r in before])


def test_no_benchmark_item_left(spark, stages):
    before, after = stages["benchmark decontamination"]
    rows = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    items = decontaminate.Items([r.item_id for r in rows], [decontaminate.normal(r.text) for r in rows], 8, 0.1)
    leaky = {r.doc_id for r in before if decontaminate.leaks(items, decontaminate.normal(r.text))}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - leaky


def test_mix_repeats_whole_documents(stages):
    before, after = stages["mixing to target weights"]
    size, source = {r.doc_id: len(r.text.split()) for r in before}, {r.doc_id: r.source for r in before}
    times = Counter(r.doc_id for r in after)
    assert max(times.values()) <= 3 and set(times) <= set(size)
    total = defaultdict(int)
    for d, n in times.items():
        total[source[d]] += n * size[d]
    assert abs(sum(total.values()) - sum(size.values())) <= 0.1 * sum(size.values())


def test_shards(stages):
    before, after = stages["sharding"]
    assert Counter(tuple(r)[:5] for r in after) == Counter(map(tuple, before))
    count = Counter(r.shard for r in after)
    assert max(count.values()) - min(count.values()) <= 1
    assert sorted((r.shard, r.slot) for r in after) == [(s, i) for s in range(8) for i in range(count[s])]


def test_run_equals_the_stages(spark, stages):
    got = pipeline.run(spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, stages["sharding"][1]))


def test_edge_documents_go_through_every_stage(spark, edge_docs, no_docs, tmp_path):
    for source in (edge_docs, no_docs):
        docs = source
        for n, (name, stage) in enumerate(pipeline.STAGES):
            path = str(tmp_path / f"{len(source.columns)}-{n}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() >= 0 and {"shard", "slot"} <= set(docs.columns)


def test_the_rest_works_without_these_operators(tmp_path):
    import subprocess
    import sys

    root = Path(pipeline.__file__).parent
    for name in ("movewatch", "__spark_entry__.py"):
        source = root / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'pipeline' not in n and set(n) == set(e.oracle_sql()); print(len(n))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 100, done.stderr
