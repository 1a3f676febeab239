"""A catalogue page as one answer: results in order, facets that leave their own group out, and where the shopper is.

The scope (products of the node, type and text asked for) is staged once. What depends on the whole scope, the ladder
of price buckets and the one product type whose specs can be filtered by, is a scalar aggregate inside the
queries. Each row carries a bitmask of the groups of filters that it fails: a result fails none, and a
row is counted in a facet if it fails no group but that facet's own, so one aggregate counts all facets.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.roles import REGISTRY, Roles
from ..sources.staging import Stages
from .catalogue import PRICE_LADDERS, RATING_OPTIONS, SIZE_BUCKETS, SORTS, product_summary, sold_under, spec_options
from .ranking import keyed, place_all, sort_key
from .trees import rooted

#: Bit of each group of filters.
GROUPS = {"brand": 1, "price": 2, "rating": 4, "marketplace": 8, "availability": 16, "specs": 32}
_FILTERABLE = {key: (k, name, kind, unit) for k, (key, name, _, unit, _, filterable, kind, _) in enumerate(REGISTRY) if filterable}


@dataclass(frozen=True)
class Request:
    """What a shopper asked for; empty fields ask for nothing."""

    query: str = ""
    product_type: str | None = None
    node: str | None = None
    brands: tuple[str, ...] = ()
    #: Places in the scope's own ladder, as text; one that the ladder lacks matches nothing.
    prices: tuple[str, ...] = ()
    #: Option of the rating facet; an unknown one asks for nothing.
    rating: str | None = None
    marketplaces: tuple[int, ...] = ()
    in_stock_only: bool = False
    #: (attribute, labels asked for), of the scope's one product type.
    specs: tuple[tuple[str, tuple[str, ...]], ...] = ()
    sort: str = "relevance"


def request_of(params: Mapping[str, str]) -> Request:
    """A page's address as a request: lists are joined by commas, specs have the prefix spec_. Unknown sorts are relevance."""
    many = lambda key: tuple(x for x in params.get(key, "").split(",") if x)
    specs = tuple((key.removeprefix("spec_"), many(key)) for key in params if key.startswith("spec_") and params[key])
    sort = params.get("sort", "relevance")
    return Request(
        query=params.get("q", ""), product_type=params.get("pt") or None, node=params.get("cat") or None, brands=many("brand"), prices=many("price"), rating=params.get("rating") or None,
        marketplaces=tuple(int(x) for x in many("mp") if x.isdigit()), in_stock_only=params.get("stock") == "1", specs=specs, sort=sort if sort in SORTS else "relevance",
    )


def scope(r: Roles, q: Request, summary: DataFrame | None = None) -> DataFrame:
    """Summaries of the products in scope, each with a map of its filterable specs to the labels that filters ask for."""
    rows = product_summary(r) if summary is None else summary
    if q.query:
        text = F.lit(q.query.lower())
        rows = rows.where(F.contains(F.lower("canonical_name"), text) | F.contains(F.lower("brand"), text) | F.contains(F.lower("product_type"), text))
    rows = rows.where(F.col("product_type") == q.product_type) if q.product_type else rows
    rows = rows.join(sold_under(r, q.node), "product_id", "left_semi") if q.node else rows
    return rows.join(spec_options(r), "product_id", "left")


class Page:
    """The answer to a request over a staged scope. Pages of one catalogue can share its summary."""

    def __init__(self, r: Roles, q: Request, summary: DataFrame | None = None):
        self.r, self.q = r, q
        self.stages = Stages(r.product.sparkSession)
        staged = self.stages.put("scope", scope(r, q) if summary is None else scope(r, q, summary))
        only = F.when(F.min("product_type") == F.max("product_type"), F.min("product_type"))
        top = F.max("min_price") / 100
        edges = F.array(*map(F.lit, PRICE_LADDERS[-1]))
        for ladder in reversed(PRICE_LADDERS[:-1]):
            edges = F.when(top <= ladder[-1] * 1.6, F.array(*map(F.lit, ladder))).otherwise(edges)
        edges = F.when(top.isNotNull(), F.concat(F.array(F.lit(0)), edges))
        self.context = staged.agg((F.lit(q.product_type) if q.product_type else only).alias("type"), edges.alias("edges"))
        self.edges = self.context.select("edges").scalar()
        self.type = self.context.select("type").scalar()
        located = staged.withColumns({"edges": self.edges, "scope_type": self.type}).withColumn("bucket", F.size(F.filter("edges", lambda e: e.cast("long") * 100 <= F.col("min_price"))) - 1)
        located = located.withColumn("bucket", F.when(F.col("bucket") >= 0, F.col("bucket")))
        self.rows = located.withColumn("failed", self._failed())

    def _failed(self) -> Column:
        q = self.q
        fails = {"brand": ~F.col("brand").isin(*q.brands) if q.brands else None, "availability": ~F.coalesce("any_in_stock", F.lit(False)) if q.in_stock_only else None}
        fails["price"] = ~F.coalesce(F.col("bucket").cast("string").isin(*q.prices), F.lit(False)) if q.prices else None
        least = dict(RATING_OPTIONS).get(q.rating)
        fails["rating"] = F.coalesce("rating_tenths", F.lit(0)) < least if least else None
        fails["marketplace"] = ~F.coalesce(F.arrays_overlap("marketplaces", F.array(*map(F.lit, q.marketplaces))), F.lit(False)) if q.marketplaces else None
        asked = F.lit(False)
        for key, labels in q.specs:
            if labels and key in _FILTERABLE:
                asked = asked | ~F.coalesce(F.element_at("specs", key).isin(*labels), F.lit(False))
        # Without one product type in scope there are no specs to filter by.
        fails["specs"] = F.col("scope_type").isNotNull() & asked if q.specs else None
        mask = F.lit(0)
        for group, bit in GROUPS.items():
            mask = mask + F.when(fails[group], bit).otherwise(0) if fails[group] is not None else mask
        return mask

    def results(self) -> DataFrame:
        """Matching products with their place in the order asked for."""
        column, ascending = SORTS[self.q.sort]
        value = F.unix_date("first_seen_at") if column == "first_seen_at" else F.coalesce(column, F.lit(0)) if column in ("review_count", "rating_tenths") else F.col(column)
        found = self.rows.where("failed = 0")
        places = place_all(keyed(found, {self.q.sort: sort_key(value, ascending)}, "product_id"), "product_id", self.stages)
        return found.join(places.select("product_id", "place"), "product_id").select("place", "product_id", "canonical_name", "brand", "min_price", "max_price", "rating_tenths", "review_count", "listings", "any_in_stock")

    def facets(self) -> DataFrame:
        """(facet, option, label, n, place): every option that counts a product, in the order in which it is shown."""
        one = lambda facet, option, pos, n=1: F.struct(F.lit(facet).alias("facet"), option.cast("string").alias("option"), F.lit(pos).cast("long").alias("pos"), F.lit(n).cast("long").alias("n"))
        when = lambda test, item: F.when(test, F.array(item)).otherwise(F.array())
        counted = lambda group: F.col("failed").bitwiseAND(F.lit(63 - GROUPS[group])) == 0
        options = [when(counted("brand"), one("brand", F.col("brand"), 0)), when(counted("price") & F.col("bucket").isNotNull(), one("price", F.col("bucket"), F.col("bucket")))]
        options += [when(counted("rating") & (F.coalesce("rating_tenths", F.lit(0)) >= least), one("rating", F.lit(option), k)) for k, (option, least) in enumerate(RATING_OPTIONS)]
        options.append(F.when(counted("marketplace"), F.transform(F.coalesce("marketplaces", F.array().cast("array<int>")), lambda m: one("marketplace", m, m))).otherwise(F.array()))
        options.append(when(counted("availability") & F.coalesce("any_in_stock", F.lit(False)), one("availability", F.lit("in_stock"), 0)))
        for key, (_, _, kind, _) in _FILTERABLE.items():
            label = F.element_at("specs", key)
            order = {label: k for k, (label, _, _) in enumerate(SIZE_BUCKETS)} if kind == "range" else {"true": 0, "false": 1} if kind == "boolean" else {}
            pos = F.lit(0)
            for text, k in order.items():
                pos = F.when(label == text, k).otherwise(pos)
            options.append(when(counted("specs") & F.col("scope_type").isNotNull() & label.isNotNull(), one(f"spec:{key}", label, pos)))
        # A row that fails two groups is counted nowhere.
        near = self.rows.where(F.bit_count("failed") <= 1)
        # The number in stock is shown even where it is none.
        never = self.rows.sparkSession.range(1).select(F.inline(F.array(one("availability", F.lit("in_stock"), 0, 0))))
        counts = near.select(F.inline(F.concat(*options))).union(never).groupBy("facet", "option", "pos").agg(F.sum("n").alias("n"))
        counts = counts.withColumn("options", F.count("*").over(W.partitionBy("facet"))).where("options > 1 OR facet NOT LIKE 'spec:%'")
        by_count = F.col("facet").isin("brand", *(f"spec:{key}" for key, (*_, kind, _) in _FILTERABLE.items() if kind == "enum"))
        shown = W.partitionBy("facet").orderBy(F.when(by_count, -F.col("n")).otherwise(F.col("pos")), "option")
        return counts.select("facet", "option", self._label().alias("label"), "n", F.row_number().over(shown).alias("place"))

    def _label(self) -> Column:
        def short(rupees: Column) -> Column:
            plain = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
            return F.when(rupees >= 100_000, F.concat(plain(rupees / 100_000), F.lit("L"))).when(rupees >= 1000, F.concat(plain(rupees / 1000), F.lit("k"))).otherwise(rupees.cast("string"))

        k = F.col("option").cast("int")
        low, high = F.get(self.edges, k), F.get(self.edges, k + 1)
        price = F.when(k == 0, F.concat(F.lit("Under ₹"), short(high))).when(high.isNull(), F.concat(F.lit("₹"), short(low), F.lit(" & above"))).otherwise(F.concat(F.lit("₹"), short(low), F.lit(" – ₹"), short(high)))
        out = F.when(F.col("facet") == "price", price).when(F.col("facet") == "availability", "In stock")
        for option, least in RATING_OPTIONS:
            out = out.when((F.col("facet") == "rating") & (F.col("option") == option), f"{least / 10:g}★ & above")
        for key, (_, _, kind, unit) in _FILTERABLE.items():
            if kind == "boolean":
                out = out.when(F.col("facet") == f"spec:{key}", F.when(F.col("option") == "true", "Yes").otherwise("No"))
            elif kind == "enum" and unit:
                out = out.when(F.col("facet") == f"spec:{key}", F.concat("option", F.lit(f" {unit}")))
        return out.otherwise(F.col("option"))

    def envelope(self) -> DataFrame:
        """One row: numbers of results and of products in scope, the type whose specs can be filtered by, and the node's path, children and own product types, in order."""
        r, q = self.r, self.q
        nodes = rooted(r.tree, self.stages)
        at = F.lit(q.node)
        path = nodes.where(F.col("id") == at).select("ids")
        children = r.tree.where(F.col("parent_id") == at if q.node else F.col("parent_id").isNull()).agg(F.array_sort(F.collect_list("id")).alias("ids"))
        own = r.offer.where(F.concat(F.lit("s"), F.col("seller_id")) == at).join(r.product.select("product_id", "product_type"), "product_id").agg(F.array_sort(F.collect_set("product_type")).alias("types"))
        none = F.array().cast("array<string>")
        counts = self.rows.agg(F.count_if(F.col("failed") == 0).alias("total"), F.count("*").alias("scope_total"))
        return counts.select("total", "scope_total", self.type.alias("product_type"), F.coalesce(path.scalar(), none).alias("breadcrumb"), children.scalar().alias("children"), own.scalar().alias("types"))
