"""What is gathered by offer is dealt over tasks that grow with the table, and what several frames need is made once."""

import datetime

from pyspark.sql import functions as F

from stallwise.operators import browse, catalogue, prices
from stallwise.plans import queries
from stallwise.sources import roles

DIR = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(roles, "TASK_ROWS", 500)
    r = roles.load_roles(spark, DIR)
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert r.tasks == -(-lines // 500) > 4
    for frame in (r.offer, prices.latest_observation(r), prices.commercial_state(r)):
        held = [n for (n,) in frame.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert 4 < len(held) <= r.tasks and max(held) < 1000


def test_lines_are_not_shuffled_by_seller(spark):
    plan = roles.load_roles(spark, DIR).observation._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(l_suppkey" not in plan


def test_promotions_in_force_are_counted_by_class(spark):
    day = lambda m: datetime.date(2024, m, 1)
    rows = spark.createDataFrame([(1, day(3), 900, 50, 1000), (2, day(3), 800, 0, 1000), (3, day(3), 700, 0, 1000)], "offer_id long, observed_at date, selling long, shipping long, mrp long")
    promotions = spark.createDataFrame([(1, "universal", 10, None, None), (1, "deferred", 5, day(1), day(3)), (1, "universal", 20, day(3), None), (1, "universal", 40, day(4), None), (2, "financing", 7, None, day(2))], "offer_id long, availability string, discount long, valid_from date, valid_to date")
    got = {r.offer_id: r for r in prices.with_layers(rows, promotions, classes=True).collect()}
    assert [tuple(x) for x in got[1].classes] == [("deferred", 1), ("universal", 2)] and got[2].classes == got[3].classes == []
    assert got[1].universal_effective == 920 and got[2].financing_benefit == 0 and len(got) == 3


def test_the_envelope_makes_one_summary(spark, monkeypatch):
    made = []
    summary = catalogue.product_summary
    for module in (catalogue, browse):
        monkeypatch.setattr(module, "product_summary", lambda *a: made.append(a) or summary(*a))
    assert queries.QUERIES["catalogue_envelope"](spark, DIR).count() == 4 and len(made) == 1
