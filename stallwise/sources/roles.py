"""Marketplace roles over a star schema of parts, suppliers and line items.

``load_roles`` reads the tables once and exposes each role as a lazily planned DataFrame. All derived
values are integers, dates, booleans or strings. Money is in minor units.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Default as-of date of every query.
AS_OF = "1999-06-30"
#: Line items whose offers one task gathers; the number of tasks grows with the table.
TASK_ROWS = 500_000
#: Rows of an offer are ordered by these columns; the last is the latest.
OBSERVATION_ORDER = ("observed_at", "seq", "selling", "shipping", "mrp", "in_stock")
#: Promotion type index -> availability class.
PROMOTION_CLASSES = ("universal", "universal", "universal", "conditional", "conditional", "conditional", "conditional", "deferred", "financing")
#: (marketplace, category or None for the default, referral in basis points, fixed fee in rupees, from, to or None), in order.
FEE_RULES = (
    (0, None, 1200, 25, "1995-01-01", "1998-12-31"),
    (0, None, 1300, 30, "1999-01-01", None),
    (0, "PROMO", 800, 20, "1996-01-01", None),
    (1, None, 1100, 20, "1995-01-01", None),
    (1, "SMALL", 700, 15, "1997-01-01", "1999-03-31"),
    (1, "SMALL", 750, 15, "1999-04-01", None),
    (2, None, 1500, 40, "1995-01-01", None),
    (3, "LARGE", 900, 35, "1995-01-01", None),
)
#: (key, display name, data type, unit, pricing relevant, filterable, filter type, higher is better), in order.
REGISTRY = (
    ("size", "Size", "integer", "cm", True, True, "range", True),
    ("grade", "Grade", "integer", None, True, True, "enum", False),
    ("material", "Material", "text", None, False, True, "enum", None),
    ("large", "Large", "boolean", None, False, True, "boolean", None),
)
#: Attributes of each schema version, in registry order; products without a grade are of the first.
REGISTRY_VERSIONS = {1: ("size", "material", "large"), 2: ("size", "grade", "material", "large")}
#: How inferred nodes of each marketplace's own tree are named and trusted: (marketplace, prefix, confidence, mapped by, departments or None for all).
MAPPING_PROFILES = ((0, "mk", 95, "rule", None), (1, "bz", 84, "model", ("r1", "r2")), (2, "tr", 91, "rule", ("r0", "r2", "r4")), (3, "vd", 94, "rule", ("r3",)))


@dataclass(frozen=True)
class Roles:
    product: DataFrame
    spec: DataFrame
    registry: DataFrame
    marketplace: DataFrame
    seller: DataFrame
    listing: DataFrame
    offer: DataFrame
    observation: DataFrame
    promotion: DataFrame
    fee_rule: DataFrame
    review: DataFrame
    seller_rating: DataFrame
    seller_cost: DataFrame
    tree: DataFrame
    capture_run: DataFrame
    raw_document: DataFrame
    rejected_record: DataFrame
    mapping_profile: DataFrame
    curated_mapping: DataFrame
    as_of: str = AS_OF
    #: Tasks over which whatever is gathered by offer is dealt.
    tasks: int = 1


def _minor(column: str):
    return F.floor(F.col(column) * 100 + 0.5).cast("long")


def load_roles(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> Roles:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part, supplier, nation, region = read("part"), read("supplier"), read("nation"), read("region")
    tasks = max(spark.sparkContext.defaultParallelism, -(-read("lineitem").count() // TASK_ROWS))
    line = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", F.to_date("l_shipdate").alias("observed_at"))

    product = part.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_type"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 3).alias("tier"),
        F.concat_ws(" ", "p_brand", "p_name", F.concat(F.lit("("), F.col("p_type"), F.lit(")"))).alias("canonical_name"),
        F.min("p_partkey").over(W.partitionBy("p_name", "p_brand")).alias("identity_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")).alias("first_seen_at"),
        F.when(F.col("p_partkey") % 11 != 0, 2).otherwise(1).alias("spec_version"),
    )
    grade = F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey") % 7)
    values = F.array(
        F.struct(F.lit("size").alias("attribute_key"), F.col("p_size").cast("long").alias("num"), F.lit(None).cast("string").alias("txt")),
        F.struct(F.lit("grade").alias("attribute_key"), grade.cast("long").alias("num"), F.lit(None).cast("string").alias("txt")),
        F.struct(F.lit("material").alias("attribute_key"), F.lit(None).cast("long").alias("num"), F.col("p_type").alias("txt")),
        F.struct(F.lit("large").alias("attribute_key"), (F.col("p_size") > 25).cast("long").alias("num"), F.lit(None).cast("string").alias("txt")),
    )
    spec = part.select(F.col("p_partkey").alias("product_id"), F.inline(values)).where("num IS NOT NULL OR txt IS NOT NULL")
    registry = spark.createDataFrame([(i, *r) for i, r in enumerate(REGISTRY)], "ord int, attribute_key string, display_name string, data_type string, unit string, pricing boolean, filterable boolean, filter_type string, higher boolean")
    marketplace = region.select(F.col("r_regionkey").alias("marketplace_id"), F.col("r_name").alias("marketplace_name"))
    # Nations are looked up in an array, as Spark takes a join with them for a large table and would shuffle all lines by seller.
    nations = nation.agg(F.collect_list(F.struct("n_nationkey", "n_regionkey"))).scalar()
    at_home = supplier.select("s_suppkey", "s_name", "s_nationkey", F.inline(nations)).where("s_nationkey = n_nationkey")
    seller = at_home.select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("seller_name"), F.col("n_regionkey").alias("marketplace_id"), (F.col("s_suppkey") % 10).alias("seller_group"))
    at_market = line.join(seller.select(F.col("seller_id").alias("l_suppkey"), "marketplace_id"), "l_suppkey").withColumn("listing_id", F.col("l_partkey") * 10 + F.col("marketplace_id"))
    discount = _minor("l_discount")
    selling = _minor("l_extendedprice")
    observation = at_market.select(
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("offer_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"), "marketplace_id", "listing_id", "observed_at",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), selling.alias("selling"), (_minor("l_tax") * 100).alias("shipping"),
        F.floor(selling * (110 + discount) / 100).cast("long").alias("mrp"), (F.col("l_returnflag") != "R").alias("in_stock"),
        F.when(discount >= 8, F.concat(F.lit("deal-"), discount.cast("string"))).alias("sale_label"),
    )
    # Dealt before they are made distinct, so that no task holds more of them as the table grows.
    sold = line.select((F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("offer_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id")).repartition(tasks, "offer_id").distinct()
    offer = sold.join(seller.select("seller_id", "marketplace_id").distinct(), "seller_id").select("offer_id", (F.col("product_id") * 10 + F.col("marketplace_id")).alias("listing_id"), "product_id", "marketplace_id", "seller_id")
    listing = offer.select("listing_id", "product_id", "marketplace_id").repartition(tasks, "product_id").distinct().withColumn("confidence_pct", 90 + (F.col("product_id") * 5 + F.col("marketplace_id")) % 10)
    listing = listing.withColumn("human_confirmed", F.col("confidence_pct") >= 97)
    k = (F.col("product_id") * 31 + F.col("seller_id") * 17) % 9
    start = F.lit("1995-01-01").cast("date")
    promotion = offer.select(
        "offer_id", k.cast("int").alias("promotion_type"), F.element_at(F.array(*map(F.lit, PROMOTION_CLASSES)), (k + 1).cast("int")).alias("availability"),
        (500 + (F.col("product_id") + F.col("seller_id")) % 20 * 250).alias("discount"),
        F.when(k != 3, F.date_add(start, (200 * k).cast("int"))).alias("valid_from"), F.when(k != 5, F.date_add(start, (200 * k + 900).cast("int"))).alias("valid_to"),
    )
    fee_rule = spark.createDataFrame([(i, m, c, b, f, a, z) for i, (m, c, b, f, a, z) in enumerate(FEE_RULES)], "ord int, marketplace_id int, category string, referral_bp int, fixed_fee int, effective_from string, effective_to string").withColumns({c: F.col(c).cast("date") for c in ("effective_from", "effective_to")})
    month = F.trunc("observed_at", "month")
    monthly = at_market.groupBy("listing_id", F.col("l_partkey").alias("product_id"), month.alias("captured_at")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.sum("l_linenumber").alias("r"))
    sofar = W.partitionBy("listing_id").orderBy("captured_at")
    review = monthly.select("listing_id", "product_id", "captured_at", F.sum("q").over(sofar).alias("review_count"), (30 + F.sum("r").over(sofar) % 20).alias("rating_tenths"))
    yearly = at_market.groupBy(F.col("l_suppkey").alias("seller_id"), F.trunc("observed_at", "year").alias("captured_at")).agg(F.count("*").alias("rating_count"), (30 + F.sum("l_linenumber") % 20).alias("rating_tenths"))
    cost = product.where("product_id % 3 = 0").select("product_id", (F.col("product_id") % 50 * 10000 + 50000).alias("cost"))
    tree = (
        region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("level"), F.col("r_name").alias("name"))
        .union(nation.select(F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey")), F.lit(2), "n_name"))
        .union(supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")), F.concat(F.lit("n"), F.col("s_nationkey")), F.lit(3), "s_name"))
    )
    events = read("events").select("event_id", "ts", "user_id", "event_type")
    capture_run = events.groupBy((F.col("user_id") % 5).cast("int").alias("marketplace_id"), F.to_date("ts").alias("run_date")).agg(F.count("*").alias("pages_attempted"), F.count_if(F.col("event_type") != "error").alias("pages_succeeded"))
    # What failed to parse names the page captured just before it, which may not have been kept.
    raw_document = events.where("event_type <> 'error'").select(F.col("event_id").alias("document_id"), (F.col("user_id") % 5).cast("int").alias("marketplace_id"), F.col("ts").alias("fetched_at"), F.col("event_type").alias("page_kind"))
    rejected = events.where("event_type = 'error'").select(
        F.col("event_id").alias("rejection_id"), (F.col("event_id") - 1).alias("document_id"), F.when(F.col("event_id") % 3 == 0, "listing").otherwise("offer").alias("target_entity"), F.col("ts").alias("captured_at")
    )
    mapping_profile = spark.createDataFrame([(m, x, c, b, list(d) if d else None) for m, x, c, b, d in MAPPING_PROFILES], "marketplace_id int, prefix string, confidence_pct int, mapped_by string, departments array<string>")
    # Every fifth seller's node has been placed by hand on its own marketplace.
    curated = seller.where("seller_id % 5 = 0").select(
        F.col("marketplace_id").cast("int").alias("marketplace_id"), F.concat(F.lit("s"), F.col("seller_id")).alias("node_id"), F.concat(F.lit("own-"), F.col("seller_id")).alias("external_node_id"), F.concat(F.lit("Sellers > "), F.col("seller_name")).alias("raw_path"), F.lit(99).alias("confidence_pct"), F.lit("curator").alias("mapped_by"),
    )
    return Roles(product, spec, registry, marketplace, seller, listing, offer, observation, promotion, fee_rule, review, yearly, cost, tree, capture_run, raw_document, rejected, mapping_profile, curated, as_of, tasks)
