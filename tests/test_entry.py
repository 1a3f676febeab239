import __spark_entry__ as entry
from stallwise.plans.oracle import ORACLE_SQL
from stallwise.plans.queries import QUERIES


def test_every_restatement_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry_returns_prices(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "product_id"
    assert df.count() == 200
