import pytest
from compare import check, connect

from seqloom.plans import queries

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, con, name):
    check(spark, con, PATH, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", ["dense_exons", "dense_minima", "dense_minima_small_bins", "dense_region_minima", "dense_variant_bits"])
def test_tracks_are_not_broadcast(spark, name):
    """The tables are small, so the planner would broadcast rows for every position if it were free to."""
    plan = queries.QUERIES[name](spark, PATH)._jdf.queryExecution().executedPlan().toString()
    tracks = [x for x in plan.splitlines() if "Join" in x and ("pos" in x or "bin" in x)]
    assert tracks and all("SortMergeJoin" in x for x in tracks), tracks
