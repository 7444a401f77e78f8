"""The forest has its own depth."""

from sprintgauge.operators import regressors as r


def test_forest_depth_is_mllibs_limit(spark):
    assert r.make("forest", 1, 1.0).getMaxDepth() == 30 and r.make("tree", 1, 1.0).getMaxDepth() == 10
    assert r.make("forest", 1, 1.0, maxDepth=15).getMaxDepth() == 15
