"""Detail pages as nested rows: a product with its listings, a listing with its offers, an offer with its history.

Nested parts are arrays of structs in a defined order, gathered by an aggregate on the page's own key. A family of
variants has no bound, so it is given as membership, and siblings of a product only for products asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalar import half_up
from ..sources.roles import REGISTRY_VERSIONS, Roles
from ..sources.staging import Stages
from .prices import commercial_state, current_effective_price, observed, with_layers
from .reviews import review_velocity, seller_latest_rating
from .trees import rooted


def _ordered(name: str, *fields: str) -> Column:
    """An array of structs, ordered by the fields from the first on."""
    return F.array_sort(F.collect_list(F.struct(*fields))).alias(name)


def attribute_definitions(r: Roles) -> DataFrame:
    """(version, attributes): the registry's entries of each schema version, in registry order."""
    versions = r.product.sparkSession.createDataFrame([(v, k) for v, keys in REGISTRY_VERSIONS.items() for k in keys], "version int, attribute_key string")
    return versions.join(F.broadcast(r.registry), "attribute_key").groupBy("version").agg(_ordered("attributes", "ord", "attribute_key", "display_name", "data_type", "unit"))


def product_pages(r: Roles, state: DataFrame | None = None) -> DataFrame:
    """Per product: identity, path of the node it is first sold under, attributes of its schema version, its one price, and a summary of each listing."""
    stages = Stages(r.product.sparkSession)
    state = stages.put("state", commercial_state(r)) if state is None else state
    price = stages.put("price", current_effective_price(r, state).select("product_id", F.col("universal_effective").alias("price")))
    home = r.offer.groupBy("product_id").agg(F.min("seller_id").alias("s")).select("product_id", F.concat(F.lit("s"), "s").alias("id"))
    path = home.join(rooted(r.tree, stages).select("id", F.col("names").alias("category_path")), "id", "left").drop("id")
    review = review_velocity(r).select("listing_id", "rating_tenths", "review_count")
    listed = r.listing.join(F.broadcast(r.marketplace), "marketplace_id", "left").join(review, "listing_id", "left").join(price, "product_id", "left")
    listings = listed.groupBy("product_id").agg(_ordered("listings", "listing_id", "marketplace_name", "rating_tenths", "review_count", "price"))
    out = r.product.select("product_id", "canonical_name", "brand", "product_type", "identity_id", "spec_version").join(price, "product_id", "left").join(path, "product_id", "left").join(listings, "product_id", "left")
    out = out.join(F.broadcast(attribute_definitions(r)), F.col("spec_version") == F.col("version"), "left").drop("version")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("product_id", "canonical_name", "brand", "product_type", "identity_id", "spec_version", "price", none("category_path"), none("attributes"), none("listings"))


def variant_families(r: Roles) -> DataFrame:
    """Membership of families of variants: each product's family, place in it, number of siblings and price."""
    price = current_effective_price(r).select("product_id", F.col("universal_effective").alias("price"))
    sizes = r.product.groupBy("identity_id").agg((F.count("*") - 1).alias("siblings"))
    place = F.row_number().over(W.partitionBy("identity_id").orderBy("product_id"))
    return r.product.select("product_id", "identity_id").withColumn("place", place).join(sizes, "identity_id").join(price, "product_id", "left").select("identity_id", "product_id", "place", "siblings", "price")


def siblings_of(r: Roles, asked: DataFrame) -> DataFrame:
    """asked: (product_id) -> each with its siblings and their prices, in order of id, as an array; for a bounded list of products."""
    family = variant_families(r).select("identity_id", F.col("product_id").alias("sibling_id"), "price")
    pairs = asked.join(r.product.select("product_id", "identity_id"), "product_id").join(family, "identity_id").where("product_id <> sibling_id")
    found = pairs.groupBy("product_id").agg(_ordered("siblings", "sibling_id", "price"))
    return asked.join(found, "product_id", "left")


def offer_cards(r: Roles, state: DataFrame) -> DataFrame:
    """Offers, with the numbers of their promotions by class, as a listing shows them: seller and rating, prices, discount off the list price, promotions in force by class, and whether the offer is the featured one.

    Featured is the first in stock by effective price. Classes without a promotion in force are left out.
    """
    rated = seller_latest_rating(r).select("seller_id", F.col("rating_tenths").alias("seller_rating"))
    off = F.when(F.col("mrp") != 0, half_up((F.col("mrp") - F.col("selling")) * 10000 / F.col("mrp")))
    order = W.partitionBy("listing_id").orderBy("universal_effective", "offer_id")
    rows = state.join(r.seller.select("seller_id", "seller_name"), "seller_id", "left").join(rated, "seller_id", "left")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("first", F.min(F.when(F.col("in_stock"), F.col("place"))).over(W.partitionBy("listing_id")))
    return rows.select(
        "listing_id", "place", "offer_id", "seller_name", "seller_rating", "in_stock", "landed", "universal_effective", "conditional_best", off.alias("discount_bp"),
        F.col("classes").alias("promotions"), F.coalesce(F.col("place") == F.col("first"), F.lit(False)).alias("featured"),
    )


def listing_pages(r: Roles, state: DataFrame | None = None) -> DataFrame:
    """Per listing: marketplace, product, review figures, its featured offer (null when all are out of stock) and all its offers by effective price."""
    state = commercial_state(r, classes=True) if state is None else state
    cards = offer_cards(r, state)
    fields = [c for c in cards.columns if c != "listing_id"]
    offers = cards.groupBy("listing_id").agg(F.max(F.when(F.col("featured"), F.col("offer_id"))).alias("featured_offer"), _ordered("offers", *fields))
    review = review_velocity(r).select("listing_id", "rating_tenths", "review_count", "velocity_milli")
    out = r.listing.join(F.broadcast(r.marketplace), "marketplace_id", "left").join(r.product.select("product_id", "canonical_name"), "product_id", "left").join(review, "listing_id", "left").join(offers, "listing_id", "left")
    return out.select("listing_id", "marketplace_name", "product_id", "canonical_name", "confidence_pct", "rating_tenths", "review_count", "velocity_milli", "featured_offer", "offers")


def price_histories(r: Roles) -> DataFrame:
    """Per listing and offer: its seller and all its observations in order, each with landed and effective price on its own day, in stock or not."""
    rows = with_layers(observed(r), r.promotion)
    series = rows.groupBy("listing_id", "offer_id", "seller_id").agg(_ordered("observations", "observed_at", "seq", "selling", "landed", "universal_effective", "in_stock"))
    return series.join(r.seller.select("seller_id", "seller_name"), "seller_id", "left").select("listing_id", "offer_id", "seller_name", "observations")
