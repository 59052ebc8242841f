import pytest

from parchment import catalog
from tests.oracles import SMALL, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SMALL), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_driver_contract(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns == ["doc_id", "ordinal", "matched", "tf", "score"]


def test_greedy_clusters_against_brute_force(spark):
    from parchment.operators.history import greedy_clusters

    data = [("a", float(x)) for x in (1, 2, 3, 12, 13, 30)] + [("b", 5.0), ("b", 14.9), ("b", 15.0)]
    got = sorted(tuple(r) for r in greedy_clusters(spark.createDataFrame(data, "lane string, x double"), "lane", "x", 10.0).collect())
    assert got == [("a", 0, 1.0, 3.0, 3), ("a", 1, 12.0, 13.0, 2), ("a", 2, 30.0, 30.0, 1), ("b", 0, 5.0, 14.9, 2), ("b", 1, 15.0, 15.0, 1)]


def test_sliding_log_counts_accepted_calls_only(spark):
    from parchment.operators.forum import sliding_log

    data = [(i, 1, t) for i, t in enumerate((0, 1, 2, 10, 11, 12))]
    df = spark.createDataFrame(data, "event_id long, user_id long, s long").selectExpr("event_id", "user_id", "timestamp_seconds(s) as ts")
    got = [r.allowed for r in sliding_log(df, "user_id", "ts", "event_id", 2, 9.0).orderBy("event_id").collect()]
    assert got == [True, True, False, True, True, False]


def test_greedy_pairs_take_the_best_first(spark):
    from parchment.operators.derivation import greedy_pairs

    data = [("x", 1, 10, 1), ("x", 1, 11, 3), ("x", 2, 11, 3), ("x", 2, 10, 2), ("x", 3, 10, 2), ("y", 1, 10, 1)]
    got = sorted(tuple(r) for r in greedy_pairs(spark.createDataFrame(data, "block string, a int, b int, score int"), "block", "a", "b").collect())
    assert got == [("x", 1, 11, 3), ("x", 2, 10, 2), ("y", 1, 10, 1)]
