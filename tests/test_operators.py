import datetime

import numpy as np
from pyspark.sql import functions as F

from stallwise.functions.scalar import age_label, compact_money, day_label, grouped_money, half_up, model_name, moment_label, percent_label, price_proximity, psych_snap, token_jaccard
from stallwise.operators import browse, catalogue, competitive, hedonic, history, prices, stats

D = datetime.date


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_rounding_and_names(spark):
    r = one(spark, a=half_up(F.lit(2.5)), b=half_up(F.lit(-2.5)), m=model_name(F.lit("Acme Phone X (8 GB)"), F.lit("acme")), t=token_jaccard(F.lit("Blue steel"), F.lit("steel-blue")), z=price_proximity(F.lit(None).cast("long"), F.lit(5)))
    assert (r.a, r.b, r.m, r.t, r.z) == (3, -2, "Phone X", 1.0, 0.0)


def test_snap_keeps_its_bounds(spark):
    rows = spark.createDataFrame([(129_950, 120_000, 140_000), (50_000, 49_950, 50_050), (90_000, 95_000, 200_000)], "p long, low long, high long").select(psych_snap(F.col("p"), F.col("low"), F.col("high")).alias("s"), "low", "high").collect()
    assert all(r.low <= r.s <= r.high for r in rows)
    assert rows[0].s == 124_900


def test_weighted_quantiles_drop_weightless_rows(spark):
    df = spark.createDataFrame([("a", 10, 0, 1), ("a", 20, 1, 2), ("a", 40, 1, 3), ("b", 7, 2, 4)], "k string, v long, w long, t long")
    got = {r.k: r for r in stats.weighted_quantiles(df, "k", "v", "w", "t").collect()}
    assert (got["a"].wq1, got["a"].wq2, got["a"].wq3) == (20, 20, 30)
    assert got["b"].wq2 == 7


def test_sale_windows_keep_their_first_label(spark):
    df = spark.createDataFrame([(1, D(2024, 1, d), s) for d, s in ((1, None), (2, "x"), (3, "y"), (4, None), (5, "z"))], "product_id long, observed_at date, sale_label string")
    got = sorted((r.label, r.days) for r in history.sale_windows(df).collect())
    assert got == [("x", 2), ("z", 1)]


def test_promotions_have_inclusive_and_open_ends(spark):
    rows = spark.createDataFrame([(1, D(2024, 1, 5), 1000, 100, 1500), (1, D(2024, 1, 6), 1000, 0, 1500), (2, D(2024, 1, 5), 300, 0, 0)], "offer_id long, observed_at date, selling long, shipping long, mrp long")
    promos = spark.createDataFrame([(1, "universal", 200, D(2024, 1, 1), D(2024, 1, 5)), (2, "universal", 900, None, None), (1, "conditional", 50, None, D(2024, 1, 9))], "offer_id long, availability string, discount long, valid_from date, valid_to date")
    got = {(r.offer_id, r.observed_at.day): r for r in prices.with_layers(rows, promos).collect()}
    assert got[1, 5].universal_effective == 900 and got[1, 5].conditional_best == 850
    assert got[1, 6].universal_effective == 1000
    assert got[2, 5].universal_effective == 0 and got[2, 5].below_mrp_bp is None


def test_missing_texts_are_not_compared(spark):
    r = one(spark, a=competitive.attribute_score("text", competitive.token_set(F.lit("--")), competitive.token_set(F.lit("x"))), b=competitive.attribute_score("text", competitive.token_set(F.lit("n/a")), competitive.token_set(F.lit("n/a"))), c=competitive.attribute_score("integer", F.lit(0), F.lit(0)))
    assert (r.a, r.b, r.c) == (None, 1.0, 1.0)


def test_price_ladder_of_an_empty_scope(spark):
    assert catalogue.price_ladder(spark.createDataFrame([], "min_price long")) == ()


def brute_fit(x, log_price, target):
    """(adjusted R2, predicted log price, features used) of one target by numpy, or None."""
    n = len(log_price)
    usable = [k for k in range(x.shape[1]) if np.isfinite(x[:, k]).all() and np.isfinite(target[k]) and len(set(x[:, k])) > 1]
    if n < 5 or not usable:
        return None
    flat = np.ptp(log_price) == 0
    strength = lambda k: 0.0 if flat else round(abs(np.corrcoef(x[:, k], log_price)[0, 1]), 9)
    chosen = sorted(usable, key=lambda k: -strength(k))[: max(1, (n - 2) // 2)]
    z = (x[:, chosen] - x[:, chosen].mean(0)) / x[:, chosen].std(0)
    design = np.concatenate((np.ones((n, 1)), z), 1)
    beta = np.linalg.solve(design.T @ design + 1e-6 * np.eye(design.shape[1]), design.T @ log_price)
    total, rest = ((log_price - log_price.mean()) ** 2).sum(), ((log_price - design @ beta) ** 2).sum()
    k = len(chosen)
    adjusted = 1 - (1 - (0.0 if flat else 1 - rest / total)) * (n - 1) / (n - k - 1)
    return adjusted, beta[0] + (target[chosen] - x[:, chosen].mean(0)) / x[:, chosen].std(0) @ beta[1:], k


def test_regressions_equal_numpy(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for product in range(60):
        n = int(r.integers(1, 11))
        x = r.integers(0, (2, 4, 50)[product % 3], (n, 4)).astype(float)
        target = r.integers(0, 9, 4).astype(float)
        price = np.full(n, 500.0) if product == 7 else np.round(np.exp(r.normal(8, 0.3, n) + x[:, 0] * 0.1))
        if product % 5 == 0:
            x[0, 1] = np.nan
        if product % 7 == 0:
            target[2] = np.nan
        want[product] = n, brute_fit(x, np.log(price), target)
        clean = lambda v: [None if np.isnan(y) else float(y) for y in v]
        rows += [(product, float(p), *clean(xs), *clean(target)) for p, xs in zip(price, x)]
    names = ["w", "x", "y", "z"]
    df = spark.createDataFrame(rows, "product_id long, c_price double, " + ", ".join([f"c_{c} double" for c in names] + [f"{c} double" for c in names]))
    got = {g.product_id: g for g in hedonic.hedonic_fit(df, tuple(names)).collect()}
    assert set(got) == set(want)
    for product, (n, fit) in want.items():
        g = got[product]
        if fit is None:
            assert (g.n, g.features, g.adjusted_r2_milli, g.predicted, g.trusted) == (n, 0, None, None, False)
        else:
            assert (g.n, g.features, g.trusted) == (n, fit[2], bool(fit[0] >= 0.5))
            assert abs(g.adjusted_r2_milli - fit[0] * 1000) < 0.51 and abs(g.predicted - np.exp(min(fit[1], 40))) < 0.51 + 1e-6 * np.exp(min(fit[1], 40))


def test_whole_sorts_place_every_row(spark):
    rows = spark.range(1000).select(F.col("id").alias("product_id"), F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("min_price")).repartition(8)
    want = sorted(range(1000), key=lambda i: (i % 7 == 0, i % 5 if i % 7 else 0, i))
    got = sorted((r.place, r.product_id) for r in catalogue.sorted_whole(rows, "price_asc").where("sort = 'price_asc'").collect())
    assert got == [(k + 1, i) for k, i in enumerate(want)]


def test_merged_prices_keep_every_offer(spark, monkeypatch):
    day = D(2024, 1, 5)
    seen = spark.createDataFrame([(1, day, 10, 1, 900, 50, 1000, True), (1, day, 10, 2, 800, 50, 1000, True), (1, day, 11, 1, 700, 0, 1000, False), (1, day, 12, 1, 990, 0, 1000, True)], "listing_id long, observed_at date, offer_id long, seq long, selling long, shipping long, mrp long, in_stock boolean")
    monkeypatch.setattr(history, "observed", lambda r: seen)
    monkeypatch.setattr(history, "with_layers", lambda rows, promotion: rows.withColumns({"universal_effective": F.col("selling") + F.col("shipping"), "sale_label": F.lit(None).cast("string")}))
    got = {r.offer_id: r.price for r in history.merged_price_offers(type("R", (), {"promotion": None})()).collect()}
    assert got == {10: 850, 11: None, 12: 990}


def test_labels_of_money_and_shares(spark):
    df = spark.createDataFrame([(None,), (0,), (99_949,), (123_450,), (12_345_678,), (-1_234_567_890,)], "x long")
    got = [tuple(r) for r in df.select(compact_money(F.col("x")), grouped_money(F.col("x"))).collect()]
    assert got[:5] == [("—", "—"), ("₹0", "₹0"), ("₹999", "₹999"), ("₹1.2k", "₹1,235"), ("₹1.23L", "₹1,23,457")]
    assert got[5][1] == "-₹1,23,45,679"
    r = one(spark, a=percent_label(F.lit(1234), signed=True), b=percent_label(F.lit(-55)), c=percent_label(F.lit(None).cast("long")), d=percent_label(F.lit(0), signed=True))
    assert tuple(r) == ("+12.3%", "-0.6%", "—", "0.0%")


def test_addresses_become_requests():
    q = browse.request_of({"q": "a", "brand": "x,,y", "price": "1,7", "rating": "r4", "mp": "2,z", "stock": "0", "spec_size": "s,m", "spec_grade": "", "cat": "", "page": "3", "sort": "best"})
    assert q == browse.Request(query="a", brands=("x", "y"), prices=("1", "7"), rating="r4", marketplaces=(2,), specs=(("size", ("s", "m")),))
    assert browse.request_of({}) == browse.Request()


def test_verdicts_and_coverage_without_candidates(spark):
    r = one(spark, **{k: competitive.verdict(kind, F.lit(x).cast("double")) for k, kind, x in (("a", "integer", 0.98), ("b", "integer", 0.15), ("c", "text", 0.01), ("d", "boolean", None))})
    assert tuple(r) == ("match", "differ", "partial", "missing")


def test_labels_of_days_and_ages(spark):
    rows = [(x,) for x in ("2024-03-09 23:59:00", "2024-03-09 23:00:31", "2024-03-09 22:30:00", "2024-03-09 00:30:00", "2024-03-08 13:29:59", "2024-02-01 12:00:00", None)]
    df = spark.createDataFrame(rows, "x string").select(F.to_timestamp("x").alias("x"))
    assert [r[0] for r in df.select(age_label(F.col("x"), F.lit("2024-03-10"))).collect()] == ["1m ago", "59m ago", "2h ago", "1d ago", "1d ago", "38d ago", "—"]
    got = [tuple(r) for r in df.select(day_label(F.col("x")), day_label(F.col("x"), year=False), moment_label(F.col("x"))).collect()]
    assert got[2] == ("9 Mar 2024", "9 Mar", "9 Mar 2024, 10:30 pm") and got[3][2] == "9 Mar 2024, 12:30 am" and got[6] == ("—",) * 3
