"""Distribution statistics, plain and weighted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalar import half_up
from ..sources.roles import Roles


def distribution_stats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """n, extremes and quartiles by linear interpolation, per key."""
    out = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return out.select(key, "n", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "most", (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def weighted_quantiles(rows: DataFrame, key: str, value: str, weight: str, tie: str, points=(0.25, 0.5, 0.75)) -> DataFrame:
    """Per key, quantiles of weighted values.

    Rows without a positive weight are dropped. A quantile is the first row at which the running weight
    reaches its share; unless it is the first row, it lies between the row before and that row, rounded.
    """
    order = W.partitionBy(key).orderBy(value, tie)
    whole = W.partitionBy(key)
    rows = rows.where(F.col(weight) > 0).withColumns({"_upto": F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum(weight).over(whole), "_before": F.lag(value).over(order)})
    out = []
    for k, p in enumerate(points):
        need = F.col("_all") * F.lit(p)
        prior = F.col("_upto") - F.col(weight)
        between = half_up(F.col("_before") + (F.col(value) - F.col("_before")) * F.least((need - prior) / F.col(weight), F.lit(1.0)))
        hit = F.when(F.col("_upto") >= need, F.struct(F.col("_upto").alias("u"), F.col(value).alias("v"), F.col(tie).alias("t"), F.when(F.col("_before").isNull(), F.col(value).cast("double")).otherwise(between.cast("double")).alias("x")))
        out.append(F.min(hit)["x"].alias(f"wq{k + 1}"))
    return rows.groupBy(key).agg(*out)


def weighted_distribution(rows: DataFrame, key: str, value: str, weight: str, tie: str) -> DataFrame:
    """n, total weight, extremes and weighted quartiles, per key, over rows with a positive weight."""
    basic = rows.where(F.col(weight) > 0).groupBy(key).agg(F.count("*").alias("n"), F.sum(weight).alias("total_weight"), F.min(value).alias("least"), F.max(value).alias("most"))
    return basic.join(weighted_quantiles(rows, key, value, weight, tie), key).withColumn("iqr", F.col("wq3") - F.col("wq1"))


def applicable_mrp(state: DataFrame, prices: DataFrame) -> DataFrame:
    """Per product the largest list price of any offer's last row, in stock or not, and whether it looks inflated (over 2.2 times the current price)."""
    mrp = state.groupBy("product_id").agg(F.max(F.when(F.col("mrp") > 0, F.col("mrp"))).alias("applicable_mrp"))
    out = mrp.join(prices.select("product_id", F.col("universal_effective").alias("price")), "product_id", "left")
    label = F.when(F.col("applicable_mrp").isNull(), "unknown").when(F.coalesce(F.col("price"), F.lit(0)) == 0, "reliable").when(F.col("applicable_mrp") * 10 > F.col("price") * 22, "inflated").otherwise("reliable")
    return out.select("product_id", "applicable_mrp", label.alias("reliability"))


def competition_stats(state: DataFrame) -> DataFrame:
    """Per product: offers, in-stock offers, listings, marketplaces, and extremes, median and spread of in-stock prices."""
    price = F.when(F.col("in_stock"), F.col("universal_effective"))
    out = state.groupBy("product_id").agg(F.count("*").alias("offers"), F.count_if("in_stock").alias("in_stock_offers"), F.count_distinct("listing_id").alias("listings"), F.count_distinct("marketplace_id").alias("marketplaces"), F.min(price).alias("least"), F.max(price).alias("most"), F.percentile(price, 0.5).alias("median"))
    return out.withColumn("spread", F.col("most") - F.col("least"))


def price_position(prices: DataFrame, state: DataFrame) -> DataFrame:
    """Where each product's median in-stock offer would rank among its own offers' prices."""
    own = state.where("in_stock").select("product_id", "universal_effective")
    mid = own.groupBy("product_id").agg(half_up(F.percentile("universal_effective", 0.5)).alias("price"))
    joined = own.join(mid, "product_id")
    out = joined.groupBy("product_id").agg(F.first("price").alias("price"), F.count("*").alias("n"), F.count_if(F.col("universal_effective") < F.col("price")).alias("sits_above"), F.count_if(F.col("universal_effective") > F.col("price")).alias("undercuts"))
    return out.select("product_id", "price", (F.col("sits_above") + 1).alias("rank"), (F.col("n") + 1).alias("of"), half_up(F.col("sits_above") * 10000 / F.col("n")).alias("percentile_bp"), "undercuts", "sits_above")


def marketplace_of(r: Roles) -> DataFrame:
    """Per product the sorted marketplaces it is listed on."""
    return r.listing.groupBy("product_id").agg(F.array_sort(F.collect_set("marketplace_id")).alias("marketplaces"))
