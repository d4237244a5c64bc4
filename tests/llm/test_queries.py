"""Every query of the operators runs; those with SQL equal it; the pipeline's stages hold against plain versions."""

from collections import Counter

import pytest
from brute import contamination, near_classes
from oracle_check import compare, duck

import corpus_pipeline
from stamina.llm import queries

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, queries.QUERIES[name], queries.ORACLES.get(name), PATH)
    assert ok, message


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").cache()
    benchmark = [tuple(r) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        columns = docs.columns
        docs = stage(spark, docs, PATH).cache()
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert set(after) <= set(before)
        if name == "near_duplicates":
            assert sorted(after) == sorted({(c, dict(before)[c]) for c, _ in near_classes(before)})
        if name == "decontamination":
            judged = contamination([t for _, t in before], benchmark)
            assert Counter(after) == Counter(r for r, (n, h, _) in zip(before, judged) if not (h and 20 * h >= n))
        if name == "sharding":
            assert Counter(after) == Counter(before)
            shards = Counter(r["shard"] for r in docs.collect())
            assert sorted((r["shard"], r["slot"]) for r in docs.collect()) == sorted((s, k) for s, n in shards.items() for k in range(n))
        else:
            assert docs.columns == columns
