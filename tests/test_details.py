"""Nested pages, mappings and rationales on small made frames."""

import pytest
from pyspark.sql import functions as F

from stallwise.operators import competitive, mapping, rationale


def test_inferred_mappings_leave_curated_pairs_and_other_departments_out(spark):
    nodes = spark.createDataFrame([("a1", ["a", "m", "a1"], ["Art", "Mid-size", "Oil paint"]), ("b1", ["b", "b1"], ["Book", "E#Books"]), ("c", ["c"], ["Cars"])], "id string, ids array<string>, names array<string>")
    profiles = spark.createDataFrame([(0, "all", 95, "rule", None), (1, "few", 80, "model", ["a"]), (2, "none", 70, "model", [])], "marketplace_id int, prefix string, confidence_pct int, mapped_by string, departments array<string>")
    curated = spark.createDataFrame([(0, "c")], "marketplace_id int, node_id string")
    got = {(r.marketplace_id, r.node_id): (r.external_node_id, r.raw_path, r.confidence_pct) for r in mapping.inferred_mappings(nodes, profiles, curated).collect()}
    assert got == {
        (0, "a1"): ("all-mid-size-oil-paint", "Art > Mid Size > Oil Paint", 95), (0, "b1"): ("all-book-e-books", "Book > E Books", 95), (1, "a1"): ("few-mid-size-oil-paint", "Art > Mid Size > Oil Paint", 80),
    }


@pytest.mark.parametrize(("own_n", "worth", "distortion"), [(1, 0, "normal"), (3, 5_000, "depressed"), (2, -4_000, "elevated")])
def test_messages_follow_counts_and_signs(spark, own_n, worth, distortion):
    t = spark.createDataFrame(
        [(1, own_n, 10_000, 30_000, 20_000.0, 21_000.0, 22_000.0, 20_500, None, worth, 0.8, distortion, 26_000, 9_900, 19_900, 25_000, None, None, "ceiling: break_even", 31_000.0)],
        "product_id long, own_n long, own_min long, own_max long, own_median double, comp_median double, normal double, anchor long, break_even_floor long, premium_evidence long, travel double, distortion string, raw_premium long, fast long, balanced long, premium long, fast_bound string, balanced_bound string, premium_bound string, pool_high double",
    )
    codes = {}
    for r in rationale.codes(t).orderBy("strategy", "place").collect():
        codes.setdefault(r.strategy, []).append((r.code, r.n))
    assert codes["fast"] == [("fast_own", own_n), ("fast_no_cost", 2)]
    assert codes["balanced"][0][0] == ("anchor_one" if own_n == 1 else "anchor_many")
    assert codes["balanced"][1][0] == {0: "worth_none", 5_000: "worth_up", -4_000: "worth_down"}[worth]
    assert codes["balanced"][2][0] == f"market_{distortion}"
    assert [c for c, _ in codes["premium"]] == ["top_own", "pool_unused", *(["worth_up", "capped"] if worth > 0 else ["worth_none"]), "bound"]
    known = {m[0] for m in rationale.MESSAGES}
    assert {c for found in codes.values() for c, _ in found} <= known


def test_salted_types_give_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(competitive, "TARGETS", 7)
    rows = spark.range(60).select(F.col("id").alias("product_id"), F.when(F.col("id") < 50, "hot").otherwise("cold").alias("product_type"), F.when(F.col("id") % 6 != 0, F.col("id")).alias("price"), F.lit(1).alias("applicable_mrp"))
    got = [(r.product_id, r.c_product_id) for r in competitive.candidate_pairs(rows).collect()]
    want = {(a, b) for a in range(60) for b in range(60) if a != b and (a < 50) == (b < 50) and b % 6}
    assert len(got) == len(want) and set(got) == want
