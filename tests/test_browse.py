"""Catalogue pages, trees, rankings and stage tables on small made frames."""

import os

import pytest
from pyspark.sql import functions as F

from stallwise.operators import browse, ranking, trees
from stallwise.sources.staging import Stages

SCOPE = "product_id long, canonical_name string, product_type string, brand string, min_price long, max_price long, marketplaces array<int>, listings long, any_in_stock boolean, rating_tenths long, review_count long, first_seen_at date, specs map<string,string>"


def summary(i, kind="pan", brand="A", price=50_000, marketplaces=(0,), stock=True, rating=40, reviews=1, **specs):
    return (i, f"{brand} {kind}", kind, brand, price, price, list(marketplaces), len(marketplaces), stock, rating, reviews, None, specs)


@pytest.fixture
def page(spark, monkeypatch):
    def make(rows, **asked):
        monkeypatch.setattr(browse, "scope", lambda r, q: spark.createDataFrame(rows, SCOPE))
        roles = type("R", (), {"product": spark.range(1)})()
        return browse.Page(roles, browse.Request(**asked))

    return make


def options(df, facet):
    return [(r.option, r.n) for r in sorted(df.collect(), key=lambda r: r.place) if r.facet == facet]


def test_facets_leave_their_own_group_out(page):
    rows = [summary(1), summary(2, brand="B", stock=False), summary(3, brand="B", marketplaces=(0, 1)), summary(4, brand="C", rating=None), summary(5, brand="C", price=None, stock=None)]
    p = page(rows, brands=("A",), in_stock_only=True)
    f = p.facets()
    assert options(f, "brand") == [("A", 1), ("B", 1), ("C", 1)]
    # 1 fails nothing, 2 fails brand and stock, the others fail brand.
    assert options(f, "availability") == [("in_stock", 1)]
    assert options(f, "marketplace") == [("0", 1)]
    assert [r.product_id for r in p.results().collect()] == [1]


def test_specs_need_one_type_in_scope(page):
    two = [summary(1, size="10 to 25"), summary(2, size="25 and more"), summary(3, kind="pot", size="25 and more")]
    asked = {"specs": (("size", ("10 to 25",)), ("unknown", ("x",)), ("large", ()))}
    mixed, single, typed = page(two, **asked), page(two[:2], **asked), page(two[:2], product_type="pan", **asked)
    assert mixed.results().count() == 3 and options(mixed.facets(), "spec:size") == []
    for p in (single, typed):
        assert [r.product_id for r in p.results().collect()] == [1]
        assert options(p.facets(), "spec:size") == [("10 to 25", 1), ("25 and more", 1)]


def test_a_price_that_the_ladder_lacks_matches_nothing(page):
    assert page([summary(1)], prices=("9",)).results().count() == 0
    p = page([summary(1, price=40_000), summary(2, price=150_000), summary(3, price=800_000)], prices=("0", "4"))
    assert [r.product_id for r in p.results().orderBy("place").collect()] == [1, 3]
    assert {r.label: r.n for r in p.facets().collect() if r.facet == "price"} == {"Under ₹500": 1, "₹1k – ₹2k": 1, "₹5k & above": 1}
    assert page([summary(1)], rating="r9").results().count() == 1


def test_an_empty_scope_still_shows_what_is_in_stock(page):
    p = page([], brands=("A",), prices=("0",))
    assert [(r.facet, r.option, r.n) for r in p.facets().collect()] == [("availability", "in_stock", 0)]
    assert p.results().count() == 0


def test_orders_put_missing_values_last(page):
    rows = [summary(1, price=None), summary(2, price=900), summary(3, price=800, rating=None), summary(4, price=900, rating=50)]
    order = lambda sort: [r.product_id for r in page(rows, sort=sort).results().orderBy("place").collect()]
    assert order("price_asc") == [3, 2, 4, 1] and order("price_desc") == [2, 4, 3, 1] and order("rating") == [4, 1, 2, 3]


def tree(spark, rows):
    return spark.createDataFrame(rows, "id string, parent_id string, level int, name string")


def test_trees_of_six_levels_and_cycles(spark):
    deep = [("a", None, 1, "A")] + [(c, p, k, c.upper()) for k, (p, c) in enumerate(zip("abcdef", "bcdefg"), 2)]
    circle = [("x", "y", 1, "X"), ("y", "z", 1, "Y"), ("z", "x", 1, "Z"), ("w", "x", 2, "W"), ("v", "w", 3, "V"), ("s", "s", 1, "S"), ("o", "gone", 1, "O")]
    nodes = trees.rooted(tree(spark, deep + circle))
    assert {r.id: r.path for r in trees.paths(nodes).collect()} == {**{c: "/".join("ABCDEFG"[: k + 1]) for k, c in enumerate("abcdefg")}, "o": "O"}
    d = {r.id: (r.department, r.depth, r.cyclic) for r in trees.departments(nodes).collect()}
    assert d["g"] == ("a", 7, False) and d["o"] == ("o", 1, False)
    assert all(d[c][0] is None and d[c][2] for c in "xyzwvs")
    under = {(r.ancestor, r.id) for r in trees.subtrees(nodes).collect()}
    assert under == {(a, b) for i, a in enumerate("abcdefg") for b in "abcdefg"[i:]} | {("o", "o")}
    assert trees.rooted(tree(spark, [])).count() == 0


def test_places_need_no_single_task(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("w")).repartition(7)
    sorts = {"up": ranking.sort_key(F.col("v"), True), "down": ranking.sort_key(F.col("w"), False)}
    got = {(r.sort, r.place): r.k for r in ranking.place_all(ranking.keyed(rows, sorts, "k"), "k", Stages(spark)).collect()}
    up, down = sorted(range(500), key=lambda i: (i % 3, i)), sorted(range(500), key=lambda i: (i % 2, -i if i % 2 == 0 else i))
    assert got == {("up", p + 1): k for p, k in enumerate(up)} | {("down", p + 1): k for p, k in enumerate(down)}


def test_stage_tables_are_deleted(spark):
    stages = Stages(spark)
    assert stages.put("one", spark.range(3)).count() == 3
    folder = stages.root.removeprefix("file:")
    assert os.listdir(folder) == ["one"]
    stages.drop("one")
    assert os.listdir(folder) == []
