"""Reports beyond their rows."""

from keyframe.plans import reports as R

D = "/root/testdata/sf0.001"


def test_metrics_scored_once(spark):
    """Names and table come from the written means: no plan of the result reads and scores the steps again."""
    got = R.metrics_wide(spark, D)
    assert "lineitem" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 7 and got.columns[0] == "task" and {"acc_click", "acc_unknown", "acc_zoom"} <= set(got.columns)
