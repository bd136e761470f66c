"""Plan shape guards: no cross/nested-loop joins, filters and column pruning
reach the parquet scan."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from chatspark.plans.registry import load_all
from chatspark.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"
NAMES = ["user_vector", "attach_user_vector", "ensemble_vote", "label_band", "split_exact", "class_report",
         "roc_auc_ovr", "wilcoxon_signed_rank", "tfidf", "class_tfidf", "histogram_bins", "drop_nulls",
         "standard_scale", "topk_words", "encode_pad", "custom_labeler_vote", "feat_mean_response_time"]


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_or_nested_loop_join(spark, name):
    plan = _plan(load_all()[name].build(spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filter_and_pruning_reach_scan(spark):
    ev = Fixtures(spark, SF).events.filter(F.col("user_id") == 7).select("event_id", "ts")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        ev.explain("formatted")
    plan = buf.getvalue()
    assert "EqualTo(user_id,7)" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan
