"""Review and seller-rating snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalar import half_up
from ..sources.roles import Roles


def review_velocity(r: Roles) -> DataFrame:
    """Per listing, reviews a day between its last two snapshots, in thousandths; null with fewer than two."""
    back = W.partitionBy("listing_id").orderBy(F.desc("captured_at"))
    older = r.review.where(F.col("captured_at") <= F.lit(r.as_of).cast("date")).select("listing_id", "product_id", "captured_at", "review_count", "rating_tenths", F.row_number().over(back).alias("n"), F.lead("review_count").over(back).alias("before"), F.lead("captured_at").over(back).alias("before_at"))
    days = F.datediff("captured_at", "before_at")
    return older.where("n = 1").select("listing_id", "product_id", "captured_at", "review_count", "rating_tenths", F.when(days > 0, half_up((F.col("review_count") - F.col("before")) * 1000 / days)).alias("velocity_milli"))


def review_metrics(r: Roles, latest: DataFrame | None = None) -> DataFrame:
    """Per product: count-weighted rating in tenths, reviews (none counts as unknown), summed velocity."""
    latest = review_velocity(r) if latest is None else latest
    counted = F.when(F.col("review_count") > 0, F.col("review_count"))
    out = latest.groupBy("product_id").agg(F.count("*").alias("listings"), F.sum(counted * F.col("rating_tenths")).alias("w"), F.sum(counted).alias("review_count"), F.sum("rating_tenths").alias("t"), F.sum("velocity_milli").alias("velocity_milli"))
    return out.select("product_id", "listings", F.coalesce(half_up(F.col("w") / F.col("review_count")), half_up(F.col("t") / F.col("listings"))).alias("rating_tenths"), "review_count", "velocity_milli")


def seller_latest_rating(r: Roles) -> DataFrame:
    rows = r.seller_rating.where(F.col("captured_at") <= F.lit(r.as_of).cast("date"))
    return rows.groupBy("seller_id").agg(F.max(F.struct("captured_at", "rating_tenths", "rating_count")).alias("s")).select("seller_id", "s.*")
