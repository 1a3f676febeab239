"""Product summaries, search, self-excluding facets and category trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.roles import REGISTRY, Roles
from ..sources.staging import Stages
from .fees import fee_rule_asof, with_net
from .prices import commercial_state, current_effective_price
from .ranking import keyed, place_all, sort_key, top_of_each
from .reviews import review_metrics, review_velocity
from .trees import paths, rooted, subtrees

#: Ladders of price-bucket edges, in rupees.
PRICE_LADDERS = ((500, 1000, 2000, 5000), (1000, 2500, 5000, 10000), (5000, 10000, 20000, 40000), (10000, 25000, 50000, 100000), (25000, 50000, 100000, 200000))
RATING_OPTIONS = (("r4", 40), ("r35", 35), ("r3", 30))
SIZE_BUCKETS = (("up to 10", 0, 10), ("10 to 25", 10, 25), ("25 and more", 25, None))


def product_summary(r: Roles, state: DataFrame | None = None) -> DataFrame:
    """Per product: price range of its listings, reach, rating, stock."""
    state = commercial_state(r) if state is None else state
    effective = F.when(F.col("in_stock"), F.col("universal_effective"))
    agg = state.groupBy("product_id").agg(F.min(effective).alias("min_price"), F.max(effective).alias("max_price"), F.array_sort(F.collect_set("marketplace_id")).alias("marketplaces"), F.count_distinct("listing_id").alias("listings"), F.count("*").alias("offers"), F.bool_or("in_stock").alias("any_in_stock"))
    rated = review_metrics(r).select("product_id", "rating_tenths", F.coalesce("review_count", F.lit(0)).alias("review_count"))
    return r.product.select("product_id", "canonical_name", "product_type", "category", "brand", "first_seen_at").join(agg, "product_id", "left").join(rated, "product_id", "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))


@dataclass(frozen=True)
class Criteria:
    """What a shopper asked for; empty fields ask for nothing."""

    query: str = ""
    product_type: str | None = None
    category: str | None = None
    brands: tuple[str, ...] = ()
    buckets: tuple[tuple[int, int | None], ...] = ()
    rating_tenths: int | None = None
    marketplaces: tuple[int, ...] = ()
    in_stock_only: bool = False
    materials: tuple[str, ...] = ()


def in_scope(c: Criteria) -> Column:
    q = c.query.lower()
    text = F.lit(True) if not q else F.contains(F.lower("canonical_name"), F.lit(q)) | F.contains(F.lower("brand"), F.lit(q)) | F.contains(F.lower("product_type"), F.lit(q))
    for column, value in (("product_type", c.product_type), ("category", c.category)):
        text = text & (F.col(column) == value) if value else text
    return text


def predicates(c: Criteria) -> dict[str, Column]:
    """One predicate for each facet group; a group that asks for nothing is true."""
    price = F.lit(not c.buckets)
    for low, high in c.buckets:
        price = price | F.coalesce((F.col("min_price") >= low) & (F.lit(True) if high is None else F.col("min_price") < high), F.lit(False))
    return {
        "brand": F.col("brand").isin(*c.brands) if c.brands else F.lit(True),
        "price": price,
        "rating": F.coalesce("rating_tenths", F.lit(0)) >= c.rating_tenths if c.rating_tenths else F.lit(True),
        "marketplace": F.coalesce(F.arrays_overlap("marketplaces", F.array(*map(F.lit, c.marketplaces))), F.lit(False)) if c.marketplaces else F.lit(True),
        "availability": F.coalesce("any_in_stock", F.lit(False)) if c.in_stock_only else F.lit(True),
        "specs": F.col("category").isin(*c.materials) if c.materials else F.lit(True),
    }


def flagged(summary: DataFrame, c: Criteria) -> DataFrame:
    """The scope with each group's predicate as a column, computed once for the results and all facets."""
    return summary.where(in_scope(c)).withColumns({f"ok_{k}": p for k, p in predicates(c).items()})


def _but(group: str | None) -> Column:
    out = F.lit(True)
    for k in ("brand", "price", "rating", "marketplace", "availability", "specs"):
        out = out & F.col(f"ok_{k}") if k != group else out
    return out


def results(flags: DataFrame) -> DataFrame:
    return flags.where(_but(None))


#: Sort -> (column, ascending); nulls come last.
SORTS = {"relevance": ("review_count", False), "reviews": ("review_count", False), "price_asc": ("min_price", True), "price_desc": ("min_price", False), "rating": ("rating_tenths", False), "recent": ("first_seen_at", False)}


def by_sort(rows: DataFrame, *sorts: str) -> DataFrame:
    """Rows once for each of the sorts, with a key that puts missing values last."""
    key = lambda column: F.unix_date(column) if column == "first_seen_at" else F.col(column)
    return keyed(rows, {sort: sort_key(key(SORTS[sort][0]), SORTS[sort][1]) for sort in sorts}, "product_id")


def sorted_results(rows: DataFrame, top: int, *sorts: str) -> DataFrame:
    """(sort, product_id, place) of the first ``top`` rows of each sort; ties go to the lesser id."""
    return top_of_each(by_sort(rows, *sorts), top, "product_id")


def sorted_whole(rows: DataFrame, *sorts: str) -> DataFrame:
    """(sort, product_id, place) of all rows of each sort; ties go to the lesser id. Places are counted by range partition."""
    return place_all(by_sort(rows, *sorts), "product_id", Stages(rows.sparkSession))


def facet_brand(flags: DataFrame) -> DataFrame:
    return flags.where(_but("brand")).groupBy("brand").agg(F.count("*").alias("n"))


def price_ladder(scope: DataFrame) -> tuple[tuple[int, int | None], ...]:
    """The bucket edges that suit a scope's largest price, in minor units."""
    most = scope.agg(F.max("min_price")).first()[0]
    if most is None:
        return ()
    ladder = next((edges for edges in PRICE_LADDERS if most / 100 <= edges[-1] * 1.6), PRICE_LADDERS[-1])
    edges = [0, *ladder]
    return tuple((a * 100, b * 100 if b else None) for a, b in zip(edges, [*ladder, None]))


def facet_price(flags: DataFrame, ladder) -> DataFrame:
    bucket = F.lit(None).cast("int")
    for k, (low, high) in reversed(list(enumerate(ladder))):
        bucket = F.when((F.col("min_price") >= low) & (F.lit(True) if high is None else F.col("min_price") < high), k).otherwise(bucket)
    return flags.where(_but("price")).withColumn("bucket", bucket).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def facet_rating(flags: DataFrame) -> DataFrame:
    options = F.array(*(F.struct(F.lit(k).alias("option"), F.lit(v).alias("least")) for k, v in RATING_OPTIONS))
    return flags.where(_but("rating")).select(F.coalesce("rating_tenths", F.lit(0)).alias("rating"), F.inline(options)).where("rating >= least").groupBy("option").agg(F.count("*").alias("n"))


def facet_marketplace(flags: DataFrame) -> DataFrame:
    return flags.where(_but("marketplace")).select(F.explode("marketplaces").alias("marketplace_id")).groupBy("marketplace_id").agg(F.count("*").alias("n"))


def facet_availability(flags: DataFrame) -> DataFrame:
    return flags.where(_but("availability")).agg(F.count_if("any_in_stock").alias("in_stock"))


def facet_specs(flags: DataFrame, r: Roles) -> DataFrame:
    """Counts of each option of each filterable attribute; facets with one option are dropped."""
    kinds = {key: kind for key, _, _, _, _, filterable, kind, _ in REGISTRY if filterable}
    pool = flags.where(_but("specs")).select("product_id").join(r.spec.where(F.col("attribute_key").isin(*kinds)), "product_id")
    ranged = F.lit(None).cast("string")
    for label, low, high in SIZE_BUCKETS:
        ranged = F.when((F.col("num") >= low) & (F.lit(True) if high is None else F.col("num") < high), label).otherwise(ranged)
    option = F.when(F.col("attribute_key").isin(*(k for k, v in kinds.items() if v == "range")), ranged).when(F.col("attribute_key").isin(*(k for k, v in kinds.items() if v == "boolean")), F.when(F.col("num") == 1, "true").otherwise("false")).otherwise(F.coalesce("txt", F.col("num").cast("string")))
    counts = pool.withColumn("option", option).where("option IS NOT NULL").groupBy("attribute_key", "option").agg(F.count("*").alias("n"))
    return counts.withColumn("options", F.count("*").over(W.partitionBy("attribute_key"))).where("options > 1").drop("options")


def category_path(tree: DataFrame) -> DataFrame:
    """Every node with its names from the root, in a tree of any depth."""
    return paths(rooted(tree))


def category_subtree(tree: DataFrame) -> DataFrame:
    """(ancestor, id) of every node and everything under it, itself included."""
    return subtrees(rooted(tree))


def sold_under(r: Roles, node: str) -> DataFrame:
    """(product_id) of the products sold by a seller under a node of the tree, itself included."""
    under = category_subtree(r.tree).where(F.col("ancestor") == node).select("id")
    return r.offer.select("product_id", F.concat(F.lit("s"), F.col("seller_id")).alias("id")).join(under, "id", "left_semi").select("product_id").distinct()


def spec_options(r: Roles) -> DataFrame:
    """(product_id, specs): a map of each filterable attribute to the label that a filter would ask for."""
    kinds = {key: kind for key, _, _, _, _, filterable, kind, _ in REGISTRY if filterable}
    of = lambda wanted: F.col("attribute_key").isin(*(k for k, v in kinds.items() if v == wanted))
    ranged = F.lit(None).cast("string")
    for label, low, high in SIZE_BUCKETS:
        ranged = F.when((F.col("num") >= low) & (F.lit(True) if high is None else F.col("num") < high), label).otherwise(ranged)
    label = F.when(of("range"), ranged).when(of("boolean"), F.when(F.col("num") == 1, "true").otherwise("false")).otherwise(F.coalesce("txt", F.col("num").cast("string")))
    rows = r.spec.where(F.col("attribute_key").isin(*kinds)).withColumn("label", label).where("label IS NOT NULL")
    return rows.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute_key", "label"))).alias("specs"))


def taxonomy_products(r: Roles) -> DataFrame:
    """Distinct products sold under every node of the tree, and of every product type."""
    sold = r.offer.select("product_id", F.concat(F.lit("s"), F.col("seller_id")).alias("id")).distinct()
    nodes = category_subtree(r.tree).join(sold, "id", "left").groupBy(F.col("ancestor").alias("id")).agg(F.count_distinct("product_id").alias("products"))
    return nodes.union(r.product.groupBy(F.concat(F.lit("t:"), F.col("product_type")).alias("id")).agg(F.count("*").alias("products")))


def rendered_specs(r: Roles) -> DataFrame:
    """Each product's specs as shown: Yes or No, numbers with their unit."""
    dim = F.broadcast(r.registry.select("attribute_key", "data_type", "unit"))
    shown = F.when(F.col("data_type") == "boolean", F.when(F.col("num") == 1, "Yes").otherwise("No")).otherwise(F.concat_ws(" ", F.coalesce("txt", F.col("num").cast("string")), "unit"))
    return r.spec.join(dim, "attribute_key").select("product_id", "attribute_key", shown.alias("shown"))


def listing_offers(r: Roles, state: DataFrame | None = None) -> DataFrame:
    """A listing's page: its offers by effective price, the least first, with the listing's last review figures."""
    state = commercial_state(r) if state is None else state
    order = W.partitionBy("listing_id").orderBy("universal_effective", "offer_id")
    rows = state.select("listing_id", "offer_id", "seller_id", "in_stock", "landed", "universal_effective", F.row_number().over(order).alias("place"))
    return rows.join(review_velocity(r).select("listing_id", "rating_tenths", "review_count", "velocity_milli"), "listing_id", "left")


def product_detail(r: Roles) -> DataFrame:
    """Per product: identity, listings, and its model family's other members with the least of their prices."""
    price = current_effective_price(r).select("product_id", F.col("universal_effective").alias("price"))
    own = r.product.select("product_id", "canonical_name", "brand", "product_type", "identity_id").join(price, "product_id", "left")
    # A family's least price, and the least of those that aren't the one member with it, tell each member the least of the others.
    known = F.when(F.col("price").isNotNull(), F.struct("price", "product_id"))
    first = own.groupBy("identity_id").agg(F.count("*").alias("size"), F.min(known).alias("first"))
    second = own.join(first, "identity_id").where(F.col("price").isNotNull() & (F.col("product_id") != F.col("first.product_id"))).groupBy("identity_id").agg(F.min("price").alias("second"))
    family = first.join(second, "identity_id", "left")
    listings = r.listing.groupBy("product_id").agg(F.count("*").alias("listings"))
    out = own.join(family, "identity_id").join(listings, "product_id", "left")
    others = F.when(F.col("product_id") == F.col("first.product_id"), F.col("second")).otherwise(F.col("first.price"))
    return out.select("product_id", "canonical_name", "brand", "product_type", "price", F.coalesce("listings", F.lit(0)).alias("listings"), (F.col("size") - 1).alias("siblings"), others.alias("least_sibling_price"))


def taxonomy_counts(r: Roles) -> DataFrame:
    """Offers under every node of the tree."""
    leaf = r.offer.groupBy(F.concat(F.lit("s"), F.col("seller_id")).alias("id")).agg(F.count("*").alias("n"))
    return category_subtree(r.tree).join(leaf, "id", "left").groupBy(F.col("ancestor").alias("id")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("offers"))


def marketplace_category_map(r: Roles) -> DataFrame:
    """Every category on every marketplace where it isn't sold yet, for review."""
    sold = r.listing.join(r.product.select("product_id", "category"), "product_id").select("marketplace_id", "category").distinct()
    every = r.product.select("category").distinct().crossJoin(F.broadcast(r.marketplace.select("marketplace_id")))  # two small dimensions
    return every.join(sold.withColumn("sold", F.lit(True)), ["marketplace_id", "category"], "left").select("marketplace_id", "category", F.coalesce("sold", F.lit(False)).alias("mapped"))


def key_specs(r: Roles, n: int = 3) -> DataFrame:
    """A card's first ``n`` filterable specs in registry order; booleans only where true."""
    dim = F.broadcast(r.registry.where("filterable").select("attribute_key", "ord", "data_type"))
    rows = r.spec.join(dim, "attribute_key").where("data_type <> 'boolean' OR num = 1")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("product_id").orderBy("ord"))).where(F.col("place") <= n).select("product_id", "place", "attribute_key", F.coalesce("txt", F.col("num").cast("string")).alias("value"))


def variant_siblings(r: Roles) -> DataFrame:
    """Products of one model family, pairwise, itself left out."""
    one = r.product.select("product_id", "identity_id")
    return one.join(one.select(F.col("product_id").alias("sibling_id"), "identity_id"), "identity_id").where("product_id <> sibling_id").select("product_id", "sibling_id")


def marketplace_comparison(r: Roles, state: DataFrame | None = None) -> DataFrame:
    """Per listing: cheapest in-stock offer, review figures, fee rule and net; across the product: least price and gap; the last of the cheapest listings is flagged."""
    state = commercial_state(r) if state is None else state
    best = state.groupBy("listing_id", "product_id", "marketplace_id").agg(F.count("*").alias("offers"), F.min(F.when(F.col("in_stock"), F.struct("universal_effective", "offer_id", "selling", "shipping"))).alias("b"))
    rows = best.join(r.product.select("product_id", "category"), "product_id").select("listing_id", "product_id", "marketplace_id", "category", "offers", F.col("b.universal_effective").alias("price"), F.col("b.offer_id").alias("offer_id"), F.col("b.selling").alias("selling"), F.col("b.shipping").alias("shipping"))
    rows = with_net(fee_rule_asof(r, rows, r.as_of)).join(review_velocity(r).select("listing_id", "rating_tenths", "review_count", "velocity_milli"), "listing_id", "left")
    across = W.partitionBy("product_id")
    least = F.min("price").over(across)
    last = F.max(F.when(F.col("price") == F.col("cheapest"), F.col("listing_id"))).over(across)
    return rows.withColumns({"cheapest": least, "gap": F.coalesce(F.max("price").over(across) - least, F.lit(0))}).withColumn("is_cheapest", F.coalesce(F.col("listing_id") == last, F.lit(False))).select("listing_id", "offers", "price", "offer_id", "net", "rating_tenths", "review_count", "velocity_milli", "cheapest", "gap", "is_cheapest")


def search_products(r: Roles, query: str, category: str | None = None) -> DataFrame:
    """Name search of the products API: trimmed query, name only, category equal; listing count and the one product price."""
    q = query.strip().lower()
    rows = r.product.where(F.contains(F.lower("canonical_name"), F.lit(q)))
    rows = rows.where(F.col("category") == category) if category else rows
    listings = r.listing.groupBy("product_id").agg(F.count("*").alias("listings"))
    price = current_effective_price(r).select("product_id", F.col("universal_effective").alias("price"))
    return rows.select("product_id", "canonical_name", "brand").join(listings, "product_id", "left").join(price, "product_id", "left").join(review_metrics(r).select("product_id", "rating_tenths"), "product_id", "left").withColumn("listings", F.coalesce("listings", F.lit(0)))


#: Sellers of a group that one task pairs with all its members.
GROUP_PART = 1000


def seller_group_members(r: Roles) -> DataFrame:
    """Each seller with every other of its group. Groups are few, so a group's sellers are dealt into parts, each of which meets all its members in one task."""
    one = r.seller.select("seller_id", "seller_group")
    n = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = one.groupBy("seller_group").agg(F.ceil(F.count("*") / GROUP_PART).cast("int").alias("parts"))
    dealt = one.join(parts, "seller_group")
    sellers = dealt.withColumn("part", F.pmod(F.xxhash64("seller_id"), F.col("parts")).cast("int")).drop("parts")
    members = dealt.select("seller_group", F.col("seller_id").alias("member_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # A number of partitions of its own: by their bytes all of these would be put into one. Nothing is broadcast.
    sellers, members = (x.repartition(n, "seller_group", "part") for x in (sellers, members))
    return sellers.hint("shuffle_hash").join(members, ["seller_group", "part"]).where("seller_id <> member_id").select("seller_id", "member_id")
