"""The corpus pipeline's stages on the smallest tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from chatspark.llm.common import materialize, read_documents
    docs, out = read_documents(spark, SF), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    assert all(after.columns == columns for _, _, after in out[:-1])
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_order_and_decisions(stages):
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name in ("quality", "exact_dedup", "near_dedup"):
        before, after = stages[name]
        assert not ids(after) - ids(before)
    before, after = stages["quality"]
    assert after.count() < before.count()


def test_exact_stage_leaves_no_copies(stages):
    _, after = stages["exact_dedup"]
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in after.select("text").collect()]
    assert len(texts) == len(set(texts))


def test_near_stage_leaves_one_of_each_class(stages):
    from chatspark.llm.near_dup import occurrences
    before, after = stages["near_dedup"]
    sets = [set(occurrences(r["text"]).tolist()) for r in after.select("text").collect()]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(a & b)
            assert both < 0.8 * (len(a) + len(b) - both)
    assert 0 < after.count() <= before.count()


def test_mix_and_pack(stages):
    before, after = stages["mixing"]
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).values()) <= 2
    docs, pieces = stages["packing"]
    assert pieces.agg(F.sum((F.col("start") == 0).cast("int"))).first()[0] == docs.count()
