"""Price layers and prices on one basis: selling price plus shipping less discounts open to every buyer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalar import half_up, psych_snap
from ..sources.roles import OBSERVATION_ORDER, Roles


def up_to_now(r: Roles) -> DataFrame:
    """Observations up to the as-of date."""
    return r.observation.where(F.col("observed_at") <= F.lit(r.as_of).cast("date"))


def by_offer(r: Roles, rows: DataFrame) -> DataFrame:
    """Rows dealt by offer over as many tasks as the tables ask for, just as the offers are: joining or grouping them by offer shuffles nothing more."""
    return rows.repartition(r.tasks, "offer_id")


def observed(r: Roles) -> DataFrame:
    """Observations up to the as-of date, dealt by offer."""
    return by_offer(r, up_to_now(r))


def _latest(rows: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c not in OBSERVATION_ORDER]
    return rows.groupBy(*keys).agg(F.max(F.struct(*OBSERVATION_ORDER, *rest)).alias("o")).select(*keys, "o.*")


_KEYS = ("offer_id", "listing_id", "product_id", "marketplace_id", "seller_id")


def latest_observation(r: Roles) -> DataFrame:
    """The last row of each offer."""
    return _latest(observed(r), *_KEYS)


def with_layers(rows: DataFrame, promotions: DataFrame, classes: bool = False) -> DataFrame:
    """Adds the price ladder, with the promotions in force on each row's own date, and if asked for their numbers by class, in order.

    An offer's promotions are folded into one array first, so rows are joined once by offer and never
    multiplied by a range join. They are folded by a window, which gathers many small groups faster than an aggregate.
    """
    group = W.partitionBy("offer_id").orderBy("availability")
    gathered = F.collect_list(F.struct("availability", "discount", "valid_from", "valid_to")).over(group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    folded = promotions.select("offer_id", gathered.alias("promotions"), F.row_number().over(group).alias("nth")).where("nth = 1").drop("nth")
    live = lambda p: (p["valid_from"].isNull() | (p["valid_from"] <= F.col("observed_at"))) & (p["valid_to"].isNull() | (p["valid_to"] >= F.col("observed_at")))

    def total(kind):
        of_kind = F.filter("promotions", lambda p: (p["availability"] == kind) & live(p))
        return F.coalesce(F.aggregate(of_kind, F.lit(0).cast("long"), lambda s, p: s + p["discount"]), F.lit(0).cast("long"))

    out = rows.join(folded, "offer_id", "left").withColumns({"landed": F.col("selling") + F.col("shipping"), **{f"_{k}": total(k) for k in ("universal", "conditional", "deferred", "financing")}})
    if classes:
        held = F.transform(F.filter("promotions", live), lambda p: p["availability"])
        counted = F.transform(F.array_distinct(held), lambda a: F.struct(a.alias("availability"), F.size(F.filter(held, lambda b: b.eqNullSafe(a))).cast("long").alias("n")))
        out = out.withColumn("classes", F.array_sort(F.coalesce(counted, F.array().cast("array<struct<availability:string,n:bigint>>"))))
    out = out.withColumn("universal_discount", F.least("_universal", "landed"))
    out = out.withColumn("universal_effective", F.col("landed") - F.col("universal_discount"))
    out = out.withColumn("conditional_discount", F.least("_conditional", "universal_effective"))
    out = out.withColumn("conditional_best", F.col("universal_effective") - F.col("conditional_discount"))
    below = half_up((F.col("mrp") - F.col("universal_effective")) * 10000 / F.col("mrp"))
    return out.withColumn("below_mrp_bp", F.when(F.col("mrp") != 0, below)).withColumnsRenamed({"_deferred": "deferred_benefit", "_financing": "financing_benefit"}).drop("promotions", "_universal", "_conditional")


def commercial_state(r: Roles, classes: bool = False) -> DataFrame:
    """The latest row of each offer with its ladder."""
    return with_layers(latest_observation(r), r.promotion, classes)


#: What prices, profiles and offer statistics read of a state; the rest of a ladder isn't staged for them.
STAGED = ("product_id", "listing_id", "offer_id", "marketplace_id", "seller_id", "in_stock", "mrp", "landed", "conditional_best", "universal_discount", "universal_effective")


def staged_state(r: Roles) -> DataFrame:
    """The columns of each offer's state that later stages read."""
    return commercial_state(r).select(*STAGED)


def current_effective_price(r: Roles, state: DataFrame | None = None) -> DataFrame:
    """Per product, the in-stock offer with the least effective price; ties go to the earlier listing, then offer."""
    state = commercial_state(r) if state is None else state
    best = F.min(F.struct("universal_effective", "listing_id", "offer_id", "landed", "conditional_best", "universal_discount", "marketplace_id", "seller_id"))
    return state.where("in_stock").groupBy("product_id").agg(best.alias("b")).select("product_id", "b.*")


def effective_price_asof(r: Roles, day: str) -> DataFrame:
    """Per product, the least price of any offer's last in-stock row up to a day."""
    rows = r.observation.where("in_stock").where(F.col("observed_at") <= F.lit(day).cast("date"))
    return with_layers(_latest(by_offer(r, rows), *_KEYS), r.promotion).groupBy("product_id").agg(F.min("universal_effective").alias("price_asof"))


def ladder_rows(state: DataFrame) -> DataFrame:
    """A labelled row for each rung of an offer's ladder; discount rungs only where there is one."""
    rung = lambda n, key, always=False: F.struct(F.lit(n).alias("rung"), F.lit(key).alias("label"), F.col(key).alias("amount"), F.lit(always).alias("always"))
    rungs = F.array(rung(1, "mrp", True), rung(2, "selling", True), rung(3, "shipping"), rung(4, "landed", True), rung(5, "universal_discount"), rung(6, "universal_effective", True), rung(7, "conditional_discount"), rung(8, "conditional_best", True), rung(9, "deferred_benefit"), rung(10, "financing_benefit"))
    return state.select("offer_id", F.inline(rungs)).where("always OR amount > 0").drop("always")


def buybox_winner(r: Roles) -> DataFrame:
    """Per listing and day, the in-stock offer with the least landed price; no row where all are out of stock."""
    rows = up_to_now(r).where("in_stock").withColumn("landed", F.col("selling") + F.col("shipping"))
    return rows.groupBy("listing_id", "observed_at").agg(F.min(F.struct("landed", "offer_id")).alias("b")).select("listing_id", "observed_at", F.col("b.offer_id").alias("offer_id"), F.col("b.landed").alias("landed"))


def snapped_prices(prices: DataFrame) -> DataFrame:
    """Charm prices of each current price between nine tenths and eleven tenths of it."""
    p = F.col("universal_effective")
    low, high = half_up(p * 0.9), half_up(p * 1.1)
    return prices.select("product_id", "universal_effective", psych_snap(p, low, high).alias("snapped"))
