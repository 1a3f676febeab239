"""Price series, trends, sale windows and tracked products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalar import half_up
from ..sources.roles import Roles
from .prices import current_effective_price, effective_price_asof, observed, with_layers

SPANS = (365, 730, 1095)
SERIOUS_DROP_BP, GOOD_RISE_BP = -400, 400


def product_price_series(r: Roles) -> DataFrame:
    """Per product and day, the least effective price of an in-stock offer, with that offer's landed price and label."""
    rows = with_layers(observed(r).where("in_stock"), r.promotion)
    return rows.groupBy("product_id", "observed_at").agg(F.min(F.struct("universal_effective", "listing_id", "offer_id", "seq", "landed", "sale_label")).alias("b")).select("product_id", "observed_at", F.col("b.universal_effective").alias("price"), F.col("b.landed").alias("landed"), F.col("b.sale_label").alias("sale_label"))


def history_stats(r: Roles, series: DataFrame | None = None, spans=SPANS) -> DataFrame:
    """Per product: count, ends, extremes, medians over trailing spans of days (ends included), trend and sale days."""
    series = product_price_series(r) if series is None else series
    today = F.lit(r.as_of).cast("date")
    medians = [F.percentile(F.when(F.col("observed_at") >= F.date_sub(today, n), F.col("price")), 0.5).alias(f"median_{n}") for n in spans]
    out = series.groupBy("product_id").agg(
        F.count("*").alias("n_days"), F.min("observed_at").alias("first_date"), F.max("observed_at").alias("last_date"), F.min_by("price", "observed_at").alias("first_price"), F.max_by("price", "observed_at").alias("current_price"),
        F.min("price").alias("lowest"), F.max("price").alias("highest"), *medians, F.count("sale_label").alias("sale_days"), F.count_distinct("sale_label").alias("sale_labels"),
    )
    return out.withColumn("trend_bp", half_up((F.col("current_price") - F.col("first_price")) * 10000 / F.col("first_price"))).withColumn("above_low_bp", half_up((F.col("current_price") - F.col("lowest")) * 10000 / F.col("lowest")))


def sale_windows(series: DataFrame, key: str = "product_id") -> DataFrame:
    """Gaps and islands: runs of labelled days; a window keeps its first label, and another label doesn't end it."""
    in_order = W.partitionBy(key).orderBy("observed_at")
    starts = (F.col("sale_label").isNotNull() & F.lag("sale_label").over(in_order).isNull()).cast("int")
    marked = series.withColumn("island", F.sum(starts).over(in_order)).where("sale_label IS NOT NULL")
    return marked.groupBy(key, "island").agg(F.min("observed_at").alias("window_start"), F.max("observed_at").alias("window_end"), F.min_by("sale_label", "observed_at").alias("label"), F.count("*").alias("days")).drop("island")


def recent_rows(series: DataFrame, n: int = 30) -> DataFrame:
    """The last ``n`` rows of each product's series."""
    back = W.partitionBy("product_id").orderBy(F.desc("observed_at"))
    return series.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)


def _offer_days(r: Roles) -> DataFrame:
    rows = with_layers(observed(r), r.promotion)
    # Several rows of an offer on a day: the last counts.
    return rows.groupBy("listing_id", "observed_at", "offer_id").agg(F.max(F.struct("seq", "selling", "shipping", "mrp", "in_stock", "universal_effective", "sale_label")).alias("o"))


def merged_price_offers(r: Roles) -> DataFrame:
    """Each offer's price on each day of its listing that it was observed on, null when out of stock: the cells of the merged grid."""
    return _offer_days(r).select("listing_id", "observed_at", "offer_id", F.when(F.col("o.in_stock"), F.col("o.universal_effective")).alias("price"))


def merged_price_grid(r: Roles) -> DataFrame:
    """Listing and day with its offers' number and extreme prices, and the label and list price of the last offer that has one. Each offer's price is in merged_price_offers."""
    return _offer_days(r).groupBy("listing_id", "observed_at").agg(
        F.count("*").alias("offers"), F.count_if("o.in_stock").alias("in_stock_offers"),
        F.min(F.when(F.col("o.in_stock"), F.col("o.universal_effective"))).alias("least_price"), F.max(F.when(F.col("o.in_stock"), F.col("o.universal_effective"))).alias("most_price"),
        F.max_by("o.sale_label", F.when(F.col("o.sale_label").isNotNull(), F.col("offer_id"))).alias("sale_label"), F.max_by("o.mrp", "offer_id").alias("mrp"),
    )


def listing_history_summary(r: Roles) -> DataFrame:
    """Per listing: extremes over in-stock rows; means of each offer's first and last price whatever the stock; net change."""
    rows = with_layers(observed(r), r.promotion)
    order = F.struct("observed_at", "seq", "selling", "shipping", "mrp", "in_stock")
    per_offer = rows.groupBy("listing_id", "offer_id").agg(F.min(F.when(F.col("in_stock"), F.col("universal_effective"))).alias("low"), F.max(F.when(F.col("in_stock"), F.col("universal_effective"))).alias("high"), F.min_by("universal_effective", order).alias("first"), F.max_by("universal_effective", order).alias("last"))
    out = per_offer.groupBy("listing_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("first").alias("f"), F.sum("last").alias("l"), F.count("*").alias("n"))
    return out.select("listing_id", "low", "high", half_up(F.col("f") / F.col("n")).alias("mean_first"), half_up(F.col("l") / F.col("n")).alias("mean_last"), half_up((F.col("l") - F.col("f")) * 10000 / F.col("f")).alias("change_bp"))


def tracked_summary(r: Roles, tracked: DataFrame, week_before: str) -> DataFrame:
    """Tracked products with their current price, the price at an earlier day, and the change. Unknown ids drop out."""
    now = current_effective_price(r).select("product_id", F.col("universal_effective").alias("current_price"))
    listings = r.listing.groupBy("product_id").agg(F.count("*").alias("listings"))
    out = tracked.join(r.product.select("product_id", "canonical_name"), "product_id").join(now, "product_id", "left").join(effective_price_asof(r, week_before), "product_id", "left").join(listings, "product_id", "left")
    change = F.col("current_price") - F.col("price_asof")
    return out.select("product_id", "canonical_name", "current_price", "price_asof", F.coalesce("listings", F.lit(0)).alias("listings"), change.alias("change"), half_up(F.when(F.col("price_asof") != 0, change * 10000 / F.col("price_asof"))).alias("change_bp"))


def price_alerts(summary: DataFrame) -> DataFrame:
    kind = F.when(F.col("change_bp") <= SERIOUS_DROP_BP, "drop").when(F.col("change_bp") >= GOOD_RISE_BP, "rise")
    return summary.select("product_id", "change", "change_bp", kind.alias("alert")).where("alert IS NOT NULL")


def portfolio_position(r: Roles, tracked: DataFrame, summary: DataFrame) -> DataFrame:
    """One row: tracked products, marketplaces they are sold on, and their mean known change (0 if none is known)."""
    reach = tracked.join(r.listing, "product_id", "left").agg(F.count_distinct("product_id").alias("tracked"), F.count_distinct("marketplace_id").alias("marketplaces"))
    mean = summary.agg(F.coalesce(half_up(F.sum("change_bp") / F.count("change_bp")), F.lit(0).cast("long")).alias("mean_change_bp"))
    return reach.crossJoin(F.broadcast(mean))  # one row beside one row
