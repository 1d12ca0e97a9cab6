"""Every query against its SQL on the smallest tables."""

import pytest
from compare import connection, rows

from lexweave.operators import stats
from lexweave.plans import catalogue as queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.ORACLE_SQL:
        want = connection(data).sql(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, data):
    for name in ("exact_duplicates", "similar_titles", "article_co_occurrence", "merged"):
        text = plan(queries.QUERIES[name](spark, data))
        assert "Cartesian" not in text and "NestedLoop" not in text, name
    assert "TakeOrderedAndProject" in plan(queries.QUERIES["newest"](spark, data))
    assert "Join" not in plan(stats.co_occurrence(spark.createDataFrame([("1", ["a", "b"])], "id string, gdpr_articles array<string>")))


def test_entry(spark, data):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
