"""Driver contract and streaming twin."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_flagship(spark):
    mod = _entry()
    df = mod.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["uid", "n_msgs"] and len(df.columns) == 14


def test_queries_and_oracles_consistent():
    mod = _entry()
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


def test_stream_buffer_equals_twin(spark):
    from chatspark.plans.registry import load_all
    qs = load_all()
    a = sorted(tuple(r) for r in qs["stream_count_buffer"].build(spark, "/root/testdata/sf0.001").collect())
    b = sorted(tuple(r) for r in qs["count_buffer_twin"].build(spark, "/root/testdata/sf0.001").collect())
    assert a == b and len(a) > 0
