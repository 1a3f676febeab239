"""Evidence-gated price recommendations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, half_up, psych_snap
from ..sources.roles import REGISTRY, Roles
from ..sources.staging import Stages
from . import competitive as cs
from .fees import break_even, fee_rule_asof
from .hedonic import hedonic_fit
from .history import history_stats
from .pair_blocks import best_of_families
from .prices import current_effective_price, staged_state
from .stats import applicable_mrp, competition_stats, weighted_distribution

LEAST_MEMBERS = 3
HEALTHY_DISPERSION, EVIDENCED_CAP = 0.35, 0.25
#: How far evidence lets a price travel.
TRAVEL = {"high": 1.0, "medium-high": 0.8, "medium": 0.55, "low": 0.35}
_LEVELS = ("low", "medium", "medium-high", "high")
_CAPS = {"strong": "high", "adequate": "medium-high", "thin": "medium"}


class Parts:
    """The tables that a recommendation is made of, staged one after the other in shared storage.

    Offers' states are staged first, then what each target's candidates come to: a row with its coverage and its few
    members. Everything later reads these and not the lineage behind them. ``once`` stages what several later
    frames read; ``finish`` stages an answer and deletes all that it was made of.
    """

    def __init__(self, r: Roles):
        self.r = r
        self.stages = Stages(r.product.sparkSession)
        self._made: dict[str, DataFrame] = {}
        self.state = self.once("state", lambda: staged_state(r))
        self.prices = self.once("prices", lambda: current_effective_price(r, self.state))
        profiles = self.once("profiles", lambda: cs.profiles(r, self.state))
        blocks = self.once("blocks", lambda: best_of_families(profiles))
        rows = self.once("classified", lambda: cs.classified(blocks))
        self.coverage = self.once("coverage", lambda: cs.coverage_level(blocks, rows))
        self.members = self.once("members", lambda: cs.widened(cs.members(rows), profiles))
        self.drop("profiles", "blocks", "classified")
        self.competition = competition_stats(self.state)
        self.mrp = applicable_mrp(self.state, self.prices)

    @property
    def history(self) -> DataFrame:
        return self.once("history", lambda: history_stats(self.r))

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.stages.put(name, make())
        return self._made[name]

    def drop(self, *names: str) -> None:
        """Deletes stages that nothing reads any more, long before the answer is there."""
        self.stages.drop(*names)
        for name in names:
            del self._made[name]

    def finish(self, answer: DataFrame) -> DataFrame:
        out = self.stages.put("answer", answer)
        self.stages.drop(*self._made)
        self._made.clear()
        return out


def product_strength(p: Parts) -> DataFrame:
    """Per target, in thousandths: rating, reviews, specs and tier against its members' medians, and the weighted index."""
    numeric = [(k, higher) for k, _, kind, _, pricing, _, _, higher in REGISTRY if pricing and kind in ("integer", "decimal")]
    med = [F.percentile(f"c_spec_{k}", 0.5).alias(f"m_{k}") for k, _ in numeric]
    own = [F.first(c).alias(c) for c in ("rating_tenths", "review_count", "tier", *(f"spec_{k}" for k, _ in numeric))]
    g = p.members.groupBy("product_id").agg(*own, *med, F.percentile("c_rating_tenths", 0.5).alias("m_rating"), F.percentile("c_review_count", 0.5).alias("m_reviews"), F.percentile("c_tier", 0.5).alias("m_tier"))
    zero = F.lit(0.0)
    rating = F.coalesce(clamp((F.col("rating_tenths") - F.col("m_rating")) / 4.0, F.lit(-1.0), F.lit(1.0)), zero)
    reviews = F.when((F.col("review_count") > 0) & (F.col("m_reviews") > 0), clamp(F.log10(F.col("review_count") / F.col("m_reviews")), F.lit(-1.0), F.lit(1.0))).otherwise(zero)
    ahead, behind = F.lit(0), F.lit(0)
    for k, higher in numeric:
        mine, theirs = F.col(f"spec_{k}"), F.col(f"m_{k}")
        better, worse = (mine > theirs, mine < theirs) if higher is not False else (mine < theirs, mine > theirs)
        ahead, behind = ahead + F.coalesce(better.cast("int"), F.lit(0)), behind + F.coalesce(worse.cast("int"), F.lit(0))
    specs = F.when(ahead + behind > 0, (ahead - behind) / (ahead + behind)).otherwise(zero)
    tier = clamp(F.col("tier") - F.col("m_tier"), F.lit(-1.0), F.lit(1.0))
    out = g.select("product_id", rating.alias("r"), reviews.alias("v"), specs.alias("s"), tier.alias("t"))
    return out.select("product_id", *(half_up(F.col(c) * 1000).alias(n) for c, n in (("r", "rating_milli"), ("v", "reviews_milli"), ("s", "specs_milli"), ("t", "tier_milli"))), half_up((0.3 * F.col("r") + 0.15 * F.col("v") + 0.35 * F.col("s") + 0.2 * F.col("t")) * 1000).alias("index_milli"))


def pool_position(p: Parts) -> DataFrame:
    """Where each target's current price stands among its members' prices; ties count as not cheaper."""
    own = p.prices.select("product_id", F.col("universal_effective").alias("price"))
    rows = own.join(p.members.select("product_id", "c_price"), "product_id")
    got = rows.groupBy("product_id", "price").agg(F.count("*").alias("total"), F.count_if(F.col("c_price") < F.col("price")).alias("sits_above"), F.count_if(F.col("c_price") > F.col("price")).alias("undercuts"))
    return got.select("product_id", "price", (F.col("sits_above") + 1).alias("rank"), (F.col("total") + 1).alias("of"), "total", half_up(F.col("sits_above") * 10000 / F.col("total")).alias("percentile_bp"), "undercuts", "sits_above")


def member_stats(p: Parts) -> DataFrame:
    """Weighted distribution of each target's members."""
    return p.once("member_stats", lambda: weighted_distribution(p.members, "product_id", "c_price", "weight_milli", "c_product_id"))


def own_stats(p: Parts) -> DataFrame:
    return p.competition.where("in_stock_offers > 0").select("product_id", F.col("in_stock_offers").alias("own_n"), F.col("least").alias("own_min"), F.col("most").alias("own_max"), F.col("median").alias("own_median"))


def price_zones(p: Parts) -> DataFrame:
    """The pool: the target once, at its own median with weight 1, and its members at their evidence weight."""
    targets = p.members.select("product_id").distinct()
    own = own_stats(p).join(targets, "product_id", "left_semi").select("product_id", F.col("own_median").alias("value"), F.lit(1000).cast("long").alias("weight"), F.lit(0).cast("long").alias("tie"))
    comps = p.members.select("product_id", F.col("c_price").cast("double").alias("value"), F.col("weight_milli").alias("weight"), F.col("c_product_id").alias("tie"))
    z = weighted_distribution(own.union(comps), "product_id", "value", "weight", "tie")
    return z.select("product_id", F.col("n").alias("pool"), F.col("least").alias("floor_zone"), F.col("wq1").alias("low"), F.col("wq2").alias("middle"), F.col("wq3").alias("high"), F.col("most").alias("above"), half_up(F.col("iqr") * 1000 / F.col("wq2")).alias("concentration_milli"))


def evidence_score(p: Parts) -> DataFrame:
    """Ten weighted checks per target, their score in hundredths, and the level, capped by coverage."""
    r = p.r
    stats = member_stats(p).select("product_id", (F.col("iqr") / F.col("wq2")).alias("dispersion"))
    rules = fee_rule_asof(r, r.product.select("category").distinct().crossJoin(F.broadcast(r.marketplace.select("marketplace_id"))), r.as_of).groupBy("category").agg(F.coalesce(F.bool_or("is_category_default"), F.lit(False)).alias("uses_default"))
    match = r.listing.groupBy("product_id").agg(F.min("confidence_pct").alias("confidence"))
    promo = p.state.where("in_stock").select("product_id", (F.col("universal_discount") > 0).alias("promo")).union(p.members.select("product_id", "c_has_promo")).groupBy("product_id").agg(F.count("*").alias("n_prices"), F.count_if("promo").alias("n_promo"))
    t = p.coverage.join(stats, "product_id", "left").join(p.history.select("product_id", "n_days"), "product_id", "left").join(p.competition.select("product_id", "in_stock_offers"), "product_id", "left")
    t = t.join(r.seller_cost.select("product_id", "cost"), "product_id", "left").join(r.product.select("product_id", "category"), "product_id").join(rules, "category", "left").join(p.mrp.select("product_id", "reliability"), "product_id", "left").join(match, "product_id", "left").join(promo, "product_id", "left")
    no = F.lit(False)
    checks = {
        "breadth": (F.col("direct") >= cs.POLICY.target, 2), "depth": (F.col("effective_hundredths") >= cs.POLICY.target * 70, 2), "coherence": (F.coalesce(F.col("dispersion") <= HEALTHY_DISPERSION, no), 2),
        "history": (F.coalesce(F.col("n_days"), F.lit(0)) >= 30, 1), "competition": (F.coalesce(F.col("in_stock_offers"), F.lit(0)) >= 2, 1), "cost": (F.col("cost").isNotNull(), 1), "fees": (~F.coalesce("uses_default", no), 1),
        "mrp": (F.coalesce(F.col("reliability") == "reliable", no), 1), "match": (F.coalesce(F.col("confidence") >= 95, no), 1), "promotions": (F.coalesce((F.col("n_prices") > 0) & (F.col("n_promo") * 100 <= F.col("n_prices") * 34), no), 1),
    }
    t = t.withColumns({f"ok_{k}": c for k, (c, _) in checks.items()})
    score = sum((F.when(F.col(f"ok_{k}"), w).otherwise(0) for k, (_, w) in checks.items()), F.lit(0))
    t = t.withColumn("points", score)
    rank = F.when(F.col("points") * 10 >= 13 * 8, 3).when(F.col("points") * 10 >= 13 * 6, 2).when(F.col("points") * 10 >= 13 * 4, 1).otherwise(0)
    cap = F.lit(0)
    for level, most in _CAPS.items():
        cap = F.when(F.col("level") == level, _LEVELS.index(most)).otherwise(cap)
    level = F.element_at(F.array(*map(F.lit, _LEVELS)), F.least(rank, cap) + 1)
    return t.select("product_id", *(f"ok_{k}" for k in checks), "points", half_up(F.col("points") * 100 / 13).alias("score_hundredths"), level.alias("evidence"), (cap < rank).alias("capped"))


def market_anchor(p: Parts) -> DataFrame:
    """Normal price, distortion of the current market, and the anchor."""
    t = own_stats(p).join(member_stats(p).select("product_id", F.col("wq2").alias("comp_median")), "product_id").join(p.history.select("product_id", *(c for c in p.history.columns if c.startswith("median_"))), "product_id", "left")
    spans = [c for c in p.history.columns if c.startswith("median_")]
    t = t.withColumn("normal", F.coalesce(*(F.col(c) for c in (spans[2], spans[1])), F.col("own_median"), F.col("comp_median")))
    ratio = F.col("own_median") / F.col("normal")
    state = F.when(ratio <= 0.9, "depressed").when(ratio >= 1.1, "elevated").otherwise("normal")
    many = half_up(0.65 * F.col("own_median") + 0.35 * F.col("normal"))
    one = clamp(half_up(0.75 * F.col("own_median") + 0.25 * F.col("comp_median")), half_up(F.col("own_median") * 0.9), half_up(F.col("own_median") * 1.1))
    return t.select("product_id", "own_n", "own_min", "own_max", "own_median", "comp_median", "normal", state.alias("distortion"), F.when(F.col("own_n") >= 2, many).otherwise(one).alias("anchor"))


def price_bounds(p: Parts) -> DataFrame:
    """Ceiling and floor of each target's strategies, and whether they conflict."""
    worst = break_even(p.r).groupBy("product_id").agg(F.max("break_even").alias("break_even"))
    t = price_zones(p).join(p.mrp.select("product_id", "applicable_mrp"), "product_id", "left").join(worst, "product_id", "left")
    open_top = half_up(F.col("above") * 1.1)
    t = t.withColumn("ceiling", F.least(open_top, F.col("applicable_mrp"))).withColumn("ceiling_source", F.when(F.col("applicable_mrp") < open_top, "mrp").otherwise("range"))
    market = F.least(half_up(F.col("floor_zone") * 0.92), half_up(F.col("ceiling") * 0.85))
    t = t.withColumn("market_floor", market).withColumn("break_even_floor", half_up(F.col("break_even") * 1.02))
    t = t.withColumn("floor", F.greatest("market_floor", "break_even_floor"))
    source = F.when(F.col("break_even_floor") >= F.col("market_floor"), "break_even").otherwise("market")
    return t.select("product_id", "ceiling", "ceiling_source", "market_floor", "break_even_floor", "floor", source.alias("floor_source"), "middle", (F.col("ceiling") < F.col("floor")).alias("conflict"))


def strategy_prices(p: Parts) -> DataFrame:
    """Fast, balanced and premium prices of every target that passes the gate and has no conflict, with what binds them."""
    anchors, bounds, evidence, fits = p.once("anchors", lambda: market_anchor(p)), p.once("bounds", lambda: price_bounds(p)), p.once("evidence", lambda: evidence_score(p)), p.once("fits", lambda: hedonic_fit(p.members))
    t = anchors.join(bounds, "product_id").join(evidence.select("product_id", "evidence"), "product_id").join(p.coverage.select("product_id", (F.col("direct") + F.col("comparable")).alias("n_members")), "product_id").join(fits.select("product_id", "trusted", "predicted"), "product_id", "left")
    t = t.where((F.col("n_members") >= LEAST_MEMBERS) & ~F.col("conflict"))
    cap = EVIDENCED_CAP * F.col("anchor")
    t = t.withColumn("premium_evidence", F.when(F.coalesce("trusted", F.lit(False)), half_up(clamp(F.col("predicted") - F.col("comp_median"), -cap, cap))).otherwise(0))
    t = t.withColumn("supported", F.col("premium_evidence") > 0)
    travel = F.lit(0.5)
    for level, far in TRAVEL.items():
        travel = F.when(F.col("evidence") == level, far).otherwise(travel)
    t = t.withColumn("travel", travel)
    travel = F.col("travel")
    base = F.greatest(F.col("own_max"), F.col("anchor"))
    t = t.withColumn("raw_fast", F.greatest(F.least(half_up(F.col("own_min") * 0.985), F.col("anchor")), half_up(F.col("anchor") * 0.85)))
    t = t.withColumn("raw_balanced", half_up(F.col("anchor") + F.col("premium_evidence") * travel * 0.6))
    top = F.when(F.col("supported"), half_up(F.col("own_median") * (1 + EVIDENCED_CAP))).otherwise(F.greatest(half_up(F.col("own_median")), base))
    t = t.withColumn("raw_premium", F.least(base + F.when(F.col("supported"), half_up(F.col("premium_evidence") * travel)).otherwise(0), top))
    low, high = F.col("floor"), F.col("ceiling")
    t = t.withColumn("fast", psych_snap(clamp(F.col("raw_fast"), low, high), low, high))
    lifted = F.greatest(low, F.col("fast"))
    t = t.withColumn("balanced", psych_snap(clamp(F.col("raw_balanced"), lifted, high), lifted, high))
    t = t.withColumn("premium", psych_snap(clamp(F.col("raw_premium"), F.col("balanced"), high), F.col("balanced"), high))
    bound = lambda c: F.when(F.col(c) > high, F.concat(F.lit("ceiling: "), F.col("ceiling_source"))).when(F.col(c) < low, F.concat(F.lit("floor: "), F.col("floor_source")))
    return t.withColumns({f"{k}_bound": bound(f"raw_{k}") for k in ("fast", "balanced", "premium")})


def sanity_checks(p: Parts, strategies: DataFrame) -> DataFrame:
    """Whether each invariant holds for each recommendation."""
    t = strategies.join(p.mrp.select("product_id", "applicable_mrp"), "product_id", "left")
    far = lambda c: F.abs(F.col(c) - F.col("anchor")) > 0.35 * F.col("anchor")
    limit = F.when(F.col("supported"), half_up(F.col("own_median") * (1 + EVIDENCED_CAP))).otherwise(F.greatest("own_max", "anchor"))
    return t.select(
        "product_id", (~(far("fast") | far("balanced") | far("premium"))).alias("near_anchor"), F.coalesce(F.greatest("fast", "balanced", "premium") <= F.col("applicable_mrp"), F.lit(True)).alias("under_mrp"),
        (F.least("fast", "balanced", "premium") >= F.col("floor")).alias("over_floor"), ((F.col("fast") <= F.col("balanced")) & (F.col("balanced") <= F.col("premium"))).alias("ordered"), "supported",
        (F.greatest("fast", "balanced", "premium") <= half_up(limit * 1.02)).alias("within_own_market"), (F.col("distortion") == "normal").alias("undistorted"),
        F.coalesce(F.col("middle") >= F.col("break_even_floor"), F.lit(True)).alias("viable"),
    )


def recommendation(p: Parts) -> DataFrame:
    """A row for every product: its strategies, or why there are none."""
    s = p.once("strategies", lambda: strategy_prices(p)).select("product_id", "fast", "balanced", "premium", "evidence", "distortion")
    members = p.coverage.select("product_id", (F.col("direct") + F.col("comparable")).alias("members"))
    priced = p.prices.select("product_id", F.col("universal_effective").alias("current_price"))
    t = p.r.product.select("product_id").join(priced, "product_id", "left").join(members, "product_id", "left").join(p.once("bounds", lambda: price_bounds(p)).select("product_id", "conflict"), "product_id", "left").join(s, "product_id", "left")
    status = F.when(F.col("current_price").isNull(), "no_current_price").when(F.coalesce("members", F.lit(0)) < LEAST_MEMBERS, "too_few_comparables").when(F.coalesce("conflict", F.lit(False)), "no_valid_price").otherwise("ok")
    collapsed = F.size(F.array_distinct(F.array("fast", "balanced", "premium"))) < 3
    return t.select("product_id", "current_price", F.coalesce("members", F.lit(0)).alias("members"), status.alias("status"), "fast", "balanced", "premium", "evidence", "distortion", F.when(F.col("fast").isNotNull(), collapsed).alias("collapsed"))


def refusals(p: Parts) -> DataFrame:
    """Every product that gets no prices for want of evidence: the reason, and what would help."""
    priced = p.prices.select("product_id", F.lit(True).alias("priced"))
    t = cs.coverage_explained(p.r, p.coverage).join(priced, "product_id", "left").join(p.r.seller_cost.select("product_id", "cost"), "product_id", "left")
    reason = F.when(F.col("priced").isNull(), "no_current_price").when(~F.col("sufficient"), "too_few_comparables")
    screened = F.when(F.col("screened_out") > 0, F.concat(F.lit("review screened out: "), F.col("screened_out").cast("string")))
    helps = F.concat_ws(" | ", "shortfall", F.lit("capture more of this type on its marketplaces"), screened, F.when(F.col("cost").isNull(), "enter a seller cost"))
    return t.select("product_id", reason.alias("reason"), helps.alias("what_would_help")).where("reason IS NOT NULL")
