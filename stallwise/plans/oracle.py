"""SQL restatements of the registered queries, written apart from the DataFrame code."""

from __future__ import annotations


def _h(x: str) -> str:
    """Nearest integer, halves upwards."""
    return f"CAST(floor(({x}) + 0.5::DOUBLE) AS BIGINT)"


_DAY = "DATE '1999-06-30'"

_ROLES = f"""
product AS (
  SELECT p_partkey AS product_id, p_name AS product_type, p_type AS category, p_brand AS brand, p_size,
    CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 3 AS tier,
    p_brand || ' ' || p_name || ' (' || p_type || ')' AS canonical_name,
    min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS identity_id,
    DATE '1995-01-01' + CAST(p_partkey % 365 AS INT) AS first_seen_at,
    CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 7 END AS grade
  FROM part),
seller AS (SELECT s_suppkey AS seller_id, s_name AS seller_name, n_regionkey AS marketplace_id, s_suppkey % 10 AS seller_group FROM supplier JOIN nation ON s_nationkey = n_nationkey),
every_obs AS (
  SELECT l_partkey * 1000000 + l_suppkey AS offer_id, l_partkey AS product_id, l_suppkey AS seller_id, marketplace_id, l_partkey * 10 + marketplace_id AS listing_id,
    CAST(l_shipdate AS DATE) AS observed_at, l_orderkey * 10 + l_linenumber AS seq, {_h('l_extendedprice * 100')} AS selling, {_h('l_tax * 100')} * 100 AS shipping,
    {_h('l_discount * 100')} AS disc, l_returnflag <> 'R' AS in_stock, CAST(l_quantity AS BIGINT) AS quantity, l_linenumber
  FROM lineitem JOIN seller ON seller_id = l_suppkey),
observation AS (SELECT *, CAST(floor(selling * (110 + disc) / 100) AS BIGINT) AS mrp, CASE WHEN disc >= 8 THEN 'deal-' || disc END AS sale_label FROM every_obs),
offer AS (SELECT DISTINCT offer_id, listing_id, product_id, marketplace_id, seller_id FROM observation),
listing AS (SELECT *, confidence_pct >= 97 AS human_confirmed FROM (SELECT DISTINCT listing_id, product_id, marketplace_id, 90 + (product_id * 5 + marketplace_id) % 10 AS confidence_pct FROM offer)),
promotion AS (
  SELECT offer_id, k, CASE WHEN k <= 2 THEN 'universal' WHEN k <= 6 THEN 'conditional' WHEN k = 7 THEN 'deferred' ELSE 'financing' END AS availability, discount,
    CASE WHEN k <> 3 THEN DATE '1995-01-01' + CAST(200 * k AS INT) END AS valid_from, CASE WHEN k <> 5 THEN DATE '1995-01-01' + CAST(200 * k + 900 AS INT) END AS valid_to
  FROM (SELECT offer_id, (product_id * 31 + seller_id * 17) % 9 AS k, 500 + (product_id + seller_id) % 20 * 250 AS discount FROM offer)),
fee_rule(ord, marketplace_id, category, referral_bp, fixed_fee, effective_from, effective_to) AS (VALUES
  (0, 0, NULL, 1200, 25, DATE '1995-01-01', DATE '1998-12-31'), (1, 0, NULL, 1300, 30, DATE '1999-01-01', NULL), (2, 0, 'PROMO', 800, 20, DATE '1996-01-01', NULL), (3, 1, NULL, 1100, 20, DATE '1995-01-01', NULL),
  (4, 1, 'SMALL', 700, 15, DATE '1997-01-01', DATE '1999-03-31'), (5, 1, 'SMALL', 750, 15, DATE '1999-04-01', NULL), (6, 2, NULL, 1500, 40, DATE '1995-01-01', NULL), (7, 3, 'LARGE', 900, 35, DATE '1995-01-01', NULL)),
seller_cost AS (SELECT product_id, product_id % 50 * 10000 + 50000 AS cost FROM product WHERE product_id % 3 = 0),
tree AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent_id, 1 AS level, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 3, s_name FROM supplier),
laddered AS (
  SELECT *, landed - universal_discount AS universal_effective FROM (
    SELECT o.*, selling + shipping AS landed, least(CASE WHEN p.availability = 'universal' THEN p.discount ELSE 0 END, selling + shipping) AS universal_discount,
      CASE WHEN p.availability = 'conditional' THEN p.discount ELSE 0 END AS conditional, CASE WHEN p.availability = 'deferred' THEN p.discount ELSE 0 END AS deferred_benefit, CASE WHEN p.availability = 'financing' THEN p.discount ELSE 0 END AS financing_benefit
    FROM observation o LEFT JOIN promotion p ON p.offer_id = o.offer_id AND (valid_from IS NULL OR valid_from <= observed_at) AND (valid_to IS NULL OR valid_to >= observed_at))),
seen AS (SELECT * FROM laddered WHERE observed_at <= {_DAY}),
state AS (
  SELECT *, least(conditional, universal_effective) AS conditional_discount, universal_effective - least(conditional, universal_effective) AS conditional_best,
    CASE WHEN mrp <> 0 THEN {_h('(mrp - universal_effective) * 10000 / mrp')} END AS below_mrp_bp
  FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY observed_at DESC, seq DESC, selling DESC, shipping DESC, mrp DESC, in_stock DESC) AS rn FROM seen) WHERE rn = 1),
price AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY universal_effective, listing_id, offer_id) AS best FROM state WHERE in_stock) WHERE best = 1),
series AS (
  SELECT product_id, observed_at, universal_effective AS price, landed, sale_label FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, observed_at ORDER BY universal_effective, listing_id, offer_id, seq, landed, sale_label NULLS FIRST) AS best FROM seen WHERE in_stock) WHERE best = 1),
history AS (
  SELECT product_id, count(*) AS n_days, min(observed_at) AS first_date, max(observed_at) AS last_date, min_by(price, observed_at) AS first_price, max_by(price, observed_at) AS current_price, min(price) AS lowest, max(price) AS highest,
    quantile_cont(CASE WHEN observed_at >= {_DAY} - 365 THEN price END, 0.5) AS median_365, quantile_cont(CASE WHEN observed_at >= {_DAY} - 730 THEN price END, 0.5) AS median_730, quantile_cont(CASE WHEN observed_at >= {_DAY} - 1095 THEN price END, 0.5) AS median_1095,
    count(sale_label) AS sale_days, count(DISTINCT sale_label) AS sale_labels
  FROM series GROUP BY product_id),
monthly AS (SELECT listing_id, product_id, CAST(date_trunc('month', observed_at) AS DATE) AS captured_at, sum(quantity) AS q, sum(l_linenumber) AS r FROM observation GROUP BY ALL),
review AS (SELECT listing_id, product_id, captured_at, CAST(sum(q) OVER w AS BIGINT) AS review_count, CAST(30 + sum(r) OVER w % 20 AS BIGINT) AS rating_tenths FROM monthly WINDOW w AS (PARTITION BY listing_id ORDER BY captured_at)),
velocity AS (
  SELECT listing_id, product_id, captured_at, review_count, rating_tenths, CASE WHEN captured_at - before_at > 0 THEN {_h('(review_count - before) * 1000 / (captured_at - before_at)')} END AS velocity_milli
  FROM (SELECT *, row_number() OVER w AS n, lead(review_count) OVER w AS before, lead(captured_at) OVER w AS before_at FROM review WHERE captured_at <= {_DAY} WINDOW w AS (PARTITION BY listing_id ORDER BY captured_at DESC)) WHERE n = 1),
metrics AS (
  SELECT product_id, count(*) AS listings, coalesce({_h('sum(CASE WHEN review_count > 0 THEN review_count * rating_tenths END) / sum(CASE WHEN review_count > 0 THEN review_count END)')}, {_h('sum(rating_tenths) / count(*)')}) AS rating_tenths,
    CAST(sum(CASE WHEN review_count > 0 THEN review_count END) AS BIGINT) AS review_count, CAST(sum(velocity_milli) AS BIGINT) AS velocity_milli
  FROM velocity GROUP BY product_id),
seller_rating AS (
  SELECT seller_id, CAST(date_trunc('year', observed_at) AS DATE) AS captured_at, count(*) AS rating_count, CAST(30 + sum(l_linenumber) % 20 AS BIGINT) AS rating_tenths FROM observation GROUP BY ALL),
last_rating AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY captured_at DESC) AS n FROM seller_rating WHERE captured_at <= {_DAY}) WHERE n = 1),
rule_for AS (
  SELECT marketplace_id, category, is_default, referral_bp, fixed_fee FROM (
    SELECT m.marketplace_id, c.category, f.category IS NULL AS is_default, referral_bp, fixed_fee, row_number() OVER (PARTITION BY m.marketplace_id, c.category ORDER BY (f.category IS NULL), f.ord) AS n
    FROM (SELECT r_regionkey AS marketplace_id FROM region) m, (SELECT DISTINCT category FROM product) c, fee_rule f
    WHERE f.marketplace_id = m.marketplace_id AND (f.category IS NULL OR f.category = c.category) AND effective_from <= {_DAY} AND (effective_to IS NULL OR effective_to >= {_DAY})) WHERE n = 1),
reach AS (SELECT product_id, list_sort(list(DISTINCT marketplace_id)) AS marketplaces FROM listing GROUP BY product_id),
competition AS (
  SELECT product_id, count(*) AS offers, count_if(in_stock) AS in_stock_offers, count(DISTINCT listing_id) AS listings, count(DISTINCT marketplace_id) AS marketplaces,
    min(universal_effective) FILTER (in_stock) AS least, max(universal_effective) FILTER (in_stock) AS most, quantile_cont(universal_effective, 0.5) FILTER (in_stock) AS median
  FROM state GROUP BY product_id),
mrp AS (
  SELECT s.product_id, applicable_mrp, CASE WHEN applicable_mrp IS NULL THEN 'unknown' WHEN coalesce(universal_effective, 0) = 0 THEN 'reliable' WHEN applicable_mrp * 10 > universal_effective * 22 THEN 'inflated' ELSE 'reliable' END AS reliability
  FROM (SELECT product_id, max(CASE WHEN mrp > 0 THEN mrp END) AS applicable_mrp FROM state GROUP BY product_id) s LEFT JOIN price USING (product_id)),
summary AS (
  SELECT p.product_id, canonical_name, product_type, category, brand, first_seen_at, min_price, max_price, marketplaces, s.listings, offers, any_in_stock, rating_tenths, coalesce(review_count, 0) AS review_count
  FROM product p LEFT JOIN (
    SELECT product_id, min(universal_effective) FILTER (in_stock) AS min_price, max(universal_effective) FILTER (in_stock) AS max_price, list_sort(list(DISTINCT marketplace_id)) AS marketplaces, count(DISTINCT listing_id) AS listings, count(*) AS offers, bool_or(in_stock) AS any_in_stock
    FROM state GROUP BY product_id) s USING (product_id) LEFT JOIN metrics m USING (product_id)),
asked AS (
  SELECT *, brand IN ('Brand#1', 'Brand#10', 'Brand#12', 'Brand#15') AS ok_brand, coalesce(min_price >= 0 AND min_price < 5000000, false) AS ok_price, coalesce(rating_tenths, 0) >= 35 AS ok_rating,
    coalesce(list_has_any(marketplaces, [0, 1, 2]), false) AS ok_market, coalesce(any_in_stock, false) AS ok_stock, category IN ('SMALL', 'LARGE', 'PROMO') AS ok_specs
  FROM summary WHERE contains(lower(canonical_name), 'brand#1') OR contains(lower(brand), 'brand#1') OR contains(lower(product_type), 'brand#1')),
tracked AS (SELECT product_id FROM product),
asof_week AS (
  SELECT product_id, min(universal_effective) AS price_asof FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY observed_at DESC, seq DESC, selling DESC, shipping DESC, mrp DESC, in_stock DESC) AS rn FROM laddered WHERE in_stock AND observed_at <= DATE '1999-06-23') WHERE rn = 1 GROUP BY product_id),
track AS (
  SELECT product_id, canonical_name, universal_effective AS current_price, price_asof, coalesce(n, 0) AS listings, universal_effective - price_asof AS change, {_h('CASE WHEN price_asof <> 0 THEN (universal_effective - price_asof) * 10000 / price_asof END')} AS change_bp
  FROM tracked JOIN product USING (product_id) LEFT JOIN (SELECT product_id, universal_effective FROM price) USING (product_id) LEFT JOIN asof_week USING (product_id) LEFT JOIN (SELECT product_id, count(*) AS n FROM listing GROUP BY product_id) USING (product_id)),
quality AS (
  SELECT l.product_id, coalesce(observations, 0) AS observations, coalesce(in_stock_offers, 0) AS in_stock_offers,
    (greatest(least((confidence - 70) / 29::DOUBLE, 1), 0) + least(coalesce(observations, 0) / 90::DOUBLE, 1) + (CASE WHEN coalesce(in_stock_offers, 0) > 0 THEN 1 ELSE 0 END) + (CASE WHEN rating_tenths IS NOT NULL THEN 1 ELSE 0 END) + least(breadth / 2::DOUBLE, 1)) / 5::DOUBLE AS quality
  FROM (SELECT product_id, min(confidence_pct) AS confidence, count(DISTINCT marketplace_id) AS breadth FROM listing GROUP BY product_id) l
  LEFT JOIN (SELECT product_id, count(*) AS observations FROM seen GROUP BY product_id) USING (product_id) LEFT JOIN competition USING (product_id) LEFT JOIN metrics USING (product_id)),
profile AS (
  SELECT p.product_id, product_type, brand, tier, identity_id, category AS material, p_size AS size, grade, universal_effective AS price, universal_discount > 0 AS has_promo, marketplaces, quality, rating_tenths, review_count, applicable_mrp
  FROM product p LEFT JOIN (SELECT product_id, universal_effective, universal_discount FROM price) USING (product_id) JOIN reach USING (product_id) JOIN (SELECT product_id, quality FROM quality) USING (product_id) LEFT JOIN (SELECT product_id, rating_tenths, review_count FROM metrics) USING (product_id) LEFT JOIN mrp USING (product_id)),
compared AS (
  SELECT a.product_id, b.product_id AS c, a.price, b.price AS c_price, a.identity_id AS family, b.identity_id AS c_family, a.applicable_mrp AS cap, b.quality AS c_quality, b.brand AS c_brand, b.tier AS c_tier, b.marketplaces AS c_marketplaces, b.has_promo AS c_promo,
    a.rating_tenths, a.review_count, a.tier, a.size, a.grade, b.rating_tenths AS c_rating, b.review_count AS c_reviews, b.size AS c_size, b.grade AS c_grade,
    1 - least(abs(a.size - b.size) / greatest(abs(a.size), abs(b.size), 1)::DOUBLE, 1) AS s_size, CASE WHEN a.grade IS NOT NULL AND b.grade IS NOT NULL THEN 1 - least(abs(a.grade - b.grade) / greatest(abs(a.grade), abs(b.grade), 1)::DOUBLE, 1) END AS s_grade, CASE WHEN a.material = b.material THEN 1 ELSE 0 END AS s_material, CASE WHEN (a.size > 25) = (b.size > 25) THEN 1 ELSE 0 END AS s_large,
    len(list_intersect(a.marketplaces, b.marketplaces)) AS shared, len(list_intersect(a.marketplaces, b.marketplaces)) / len(list_distinct(list_concat(a.marketplaces, b.marketplaces))) AS market_score,
    coalesce(1 - least(abs(ln(a.price / b.price)) / ln(3::DOUBLE), 1), 0) AS price_score, 1 - abs(a.tier - b.tier) / 2 AS tier_score
  FROM profile a JOIN profile b USING (product_type) WHERE a.product_id <> b.product_id AND b.price IS NOT NULL),
scored AS (
  SELECT *, (0.45::DOUBLE * spec_score + (0.25::DOUBLE * price_score + 0.15::DOUBLE * tier_score + 0.15::DOUBLE * market_score)) / (0.45::DOUBLE + 0.25::DOUBLE + 0.15::DOUBLE + 0.15::DOUBLE) AS similarity
  FROM (SELECT *, (s_size * 2::DOUBLE + coalesce(s_grade * 2::DOUBLE, 0) + s_material + s_large) / (4::DOUBLE + CASE WHEN s_grade IS NULL THEN 0 ELSE 2 END) AS spec_score FROM compared)),
step1 AS (SELECT *, CASE WHEN shared = 0 THEN 'marketplace' WHEN c_price > cap * 1.15::DOUBLE THEN 'mrp' END AS reason1 FROM scored),
step2 AS (
  SELECT *, CASE WHEN reason1 IS NOT NULL THEN 'excluded' WHEN similarity >= 0.55::DOUBLE AND (price IS NULL OR c_price BETWEEN price * 0.6::DOUBLE AND price * 1.7::DOUBLE) AND family <> c_family THEN 'direct' WHEN similarity >= 0.4::DOUBLE AND (price IS NULL OR c_price BETWEEN price * 0.45::DOUBLE AND price * 2.2::DOUBLE) THEN 'comparable' ELSE 'reference' END AS tier1,
    row_number() OVER (PARTITION BY product_id, c_family, reason1 IS NULL ORDER BY similarity DESC, c) AS slot
  FROM step1),
step3 AS (SELECT *, CASE WHEN reason1 IS NULL AND slot > 1 THEN 'excluded' ELSE tier1 END AS tier2, CASE WHEN reason1 IS NULL AND slot > 1 THEN 'family' ELSE reason1 END AS reason2 FROM step2),
fence AS (SELECT product_id, count(*) AS n, quantile_cont(c_price, 0.25) AS q1, quantile_cont(c_price, 0.75) AS q3 FROM step3 WHERE tier2 IN ('direct', 'comparable') GROUP BY product_id),
step4 AS (
  SELECT s.*, tier2 IN ('direct', 'comparable') AND f.n >= 3 AND (c_price < q1 - (q3 - q1) * 1.5::DOUBLE OR c_price > q3 + (q3 - q1) * 1.5::DOUBLE) AS outlier FROM step3 s LEFT JOIN fence f USING (product_id)),
step5 AS (SELECT *, CASE WHEN outlier THEN 'reference' ELSE tier2 END AS tier3, CASE WHEN outlier THEN 'outlier' ELSE reason2 END AS reason3, similarity * c_quality AS worth FROM step4),
step6 AS (
  SELECT *, CASE WHEN tier3 IN ('direct', 'comparable') THEN row_number() OVER (PARTITION BY product_id, tier3 IN ('direct', 'comparable') ORDER BY (CASE WHEN tier3 = 'direct' THEN 10 ELSE 0 END) + worth DESC, c) END AS place FROM step5),
classified AS (
  SELECT *, CASE WHEN place > 10 THEN 'reference' ELSE tier3 END AS final, CASE WHEN place > 10 THEN 'rank' ELSE reason3 END AS reason FROM step6),
member AS (SELECT *, {_h("worth * (CASE WHEN final = 'direct' THEN 1::DOUBLE ELSE 0.6::DOUBLE END) * 1000")} AS weight_milli FROM classified WHERE final IN ('direct', 'comparable')),
coverage AS (
  SELECT *, CASE WHEN direct >= 5 AND effective_hundredths >= 350 THEN 'strong' WHEN direct + comparable >= 5 AND effective_hundredths >= 275 THEN 'adequate' WHEN direct + comparable >= 3 THEN 'thin' ELSE 'insufficient' END AS level FROM (
    SELECT k.product_id, candidates, direct, comparable, reference, no_marketplace, over_mrp, same_family, {_h('coalesce(w, 0) / 10')} AS effective_hundredths FROM (
      SELECT product_id, count(*) AS candidates, count_if(final = 'direct') AS direct, count_if(final = 'comparable') AS comparable, count_if(final = 'reference') AS reference,
        count_if(final = 'excluded' AND reason = 'marketplace') AS no_marketplace, count_if(final = 'excluded' AND reason = 'mrp') AS over_mrp, count_if(final = 'excluded' AND reason = 'family') AS same_family FROM classified GROUP BY product_id) k
    LEFT JOIN (SELECT product_id, sum(weight_milli) AS w FROM member GROUP BY product_id) USING (product_id)))
"""


def _weighted(name: str, source: str, key: str, value: str, weight: str, tie: str) -> str:
    """CTEs of a weighted distribution of ``source``: ``name`` has n, total_weight, least, most and wq1..wq3."""
    quarter = []
    for k, p in enumerate(("0.25", "0.5", "0.75")):
        need = f"(total * {p}::DOUBLE)"
        step = _h(f"before + (v - before) * least(({need} - (upto - w)) / w::DOUBLE, 1)")
        quarter.append(f"arg_min(CASE WHEN before IS NULL THEN v::DOUBLE ELSE {step}::DOUBLE END, (upto, v, t)) FILTER (upto >= {need}) AS wq{k + 1}")
    return f"""{name}_rows AS (
  SELECT {key} AS k, {value} AS v, {weight} AS w, {tie} AS t, sum({weight}) OVER (PARTITION BY {key} ORDER BY {value}, {tie} ROWS UNBOUNDED PRECEDING) AS upto, sum({weight}) OVER (PARTITION BY {key}) AS total, lag({value}) OVER (PARTITION BY {key} ORDER BY {value}, {tie}) AS before
  FROM {source} WHERE {weight} > 0),
{name} AS (SELECT k AS {key}, count(*) AS n, CAST(sum(w) AS BIGINT) AS total_weight, min(v) AS least, max(v) AS most, {', '.join(quarter)} FROM {name}_rows GROUP BY k)"""


_RECOMMEND = f"""
own AS (SELECT product_id, in_stock_offers AS own_n, least AS own_min, most AS own_max, median AS own_median FROM competition WHERE in_stock_offers > 0),
{_weighted('mstats', 'member', 'product_id', 'c_price', 'weight_milli', 'c')},
pooled AS (
  SELECT product_id, own_median AS value, 1000 AS weight, 0 AS tie FROM own WHERE product_id IN (SELECT product_id FROM member) UNION ALL SELECT product_id, c_price::DOUBLE, weight_milli, c FROM member),
{_weighted('pool', 'pooled', 'product_id', 'value', 'weight', 'tie')},
zones AS (SELECT product_id, n AS pool, least AS floor_zone, wq1 AS low, wq2 AS middle, wq3 AS high, most AS above, {_h('(wq3 - wq1) * 1000 / wq2')} AS concentration_milli FROM pool),
anchors AS (
  SELECT *, CASE WHEN own_median / normal <= 0.9::DOUBLE THEN 'depressed' WHEN own_median / normal >= 1.1::DOUBLE THEN 'elevated' ELSE 'normal' END AS distortion,
    CASE WHEN own_n >= 2 THEN {_h('0.65::DOUBLE * own_median + 0.35::DOUBLE * normal')} ELSE least(greatest({_h('0.75::DOUBLE * own_median + 0.25::DOUBLE * comp_median')}, {_h('own_median * 0.9::DOUBLE')}), {_h('own_median * 1.1::DOUBLE')}) END AS anchor
  FROM (SELECT own.*, wq2 AS comp_median, coalesce(median_1095, median_730, own_median, wq2) AS normal FROM own JOIN mstats USING (product_id) LEFT JOIN history USING (product_id))),
be AS (
  SELECT product_id, marketplace_id, is_default AS is_category_default, {_h('(cost + fixed_fee * 118) / (1 - referral_bp * 118 / 1000000)')} AS break_even FROM seller_cost JOIN product USING (product_id) JOIN rule_for USING (category)),
bounds AS (
  SELECT *, greatest(market_floor, break_even_floor) AS floor, ceiling < greatest(market_floor, break_even_floor) AS conflict FROM (
    SELECT *, least({_h('floor_zone * 0.92::DOUBLE')}, {_h('ceiling * 0.85::DOUBLE')}) AS market_floor FROM (
      SELECT product_id, least({_h('above * 1.1::DOUBLE')}, applicable_mrp) AS ceiling, CASE WHEN applicable_mrp < {_h('above * 1.1::DOUBLE')} THEN 'mrp' ELSE 'range' END AS ceiling_source, {_h('worst * 1.02::DOUBLE')} AS break_even_floor, floor_zone, middle
      FROM zones LEFT JOIN mrp USING (product_id) LEFT JOIN (SELECT product_id, max(break_even) AS worst FROM be GROUP BY product_id) USING (product_id)))),
promo_share AS (SELECT product_id, count(*) AS n_prices, count_if(promo) AS n_promo FROM (SELECT product_id, universal_discount > 0 AS promo FROM state WHERE in_stock UNION ALL SELECT product_id, c_promo FROM member) GROUP BY product_id),
checks AS (
  SELECT product_id, direct >= 5 AS ok_breadth, effective_hundredths >= 350 AS ok_depth, coalesce((wq3 - wq1) / wq2 <= 0.35::DOUBLE, false) AS ok_coherence, coalesce(n_days, 0) >= 30 AS ok_history, coalesce(in_stock_offers, 0) >= 2 AS ok_competition,
    cost IS NOT NULL AS ok_cost, NOT coalesce(uses_default, false) AS ok_fees, coalesce(reliability = 'reliable', false) AS ok_mrp, coalesce(confidence >= 95, false) AS ok_match, coalesce(n_prices > 0 AND n_promo * 100 <= n_prices * 34, false) AS ok_promotions, level
  FROM coverage LEFT JOIN (SELECT product_id, wq1, wq2, wq3 FROM mstats) USING (product_id) LEFT JOIN history USING (product_id) LEFT JOIN competition USING (product_id) LEFT JOIN seller_cost USING (product_id) JOIN (SELECT product_id, category FROM product) USING (product_id)
  LEFT JOIN (SELECT category, bool_or(is_default) AS uses_default FROM rule_for GROUP BY category) USING (category) LEFT JOIN mrp USING (product_id) LEFT JOIN (SELECT product_id, min(confidence_pct) AS confidence FROM listing GROUP BY product_id) USING (product_id) LEFT JOIN promo_share USING (product_id)),
points AS (SELECT *, 2 * ok_breadth::INT + 2 * ok_depth::INT + 2 * ok_coherence::INT + ok_history::INT + ok_competition::INT + ok_cost::INT + ok_fees::INT + ok_mrp::INT + ok_match::INT + ok_promotions::INT AS points FROM checks),
evidence AS (
  SELECT * EXCLUDE (rank, top, level), {_h('points * 100 / 13')} AS score_hundredths, ['low', 'medium', 'medium-high', 'high'][least(rank, top) + 1] AS evidence, top < rank AS capped FROM (
    SELECT *, CASE WHEN points * 10 >= 104 THEN 3 WHEN points * 10 >= 78 THEN 2 WHEN points * 10 >= 52 THEN 1 ELSE 0 END AS rank, CASE level WHEN 'strong' THEN 3 WHEN 'adequate' THEN 2 WHEN 'thin' THEN 1 ELSE 0 END AS top FROM points))
"""


_EXPLAINED = """
explained AS (
  SELECT product_id, CASE WHEN p_size IS NULL AND grade IS NULL AND category IS NULL THEN 'none' ELSE coalesce(level, 'insufficient') END AS level, direct >= 5 AS meets_target, direct + comparable >= 3 AS sufficient, no_marketplace + same_family + over_mrp AS screened_out,
    CASE WHEN p_size IS NULL AND grade IS NULL AND category IS NULL THEN 'no specifications' WHEN direct >= 5 THEN NULL WHEN candidates < 5 THEN 'candidates: ' || candidates || ' of 5 needed'
      ELSE 'direct: ' || direct || ' of ' || candidates || '; ' || concat_ws(', ', CASE WHEN no_marketplace > 0 THEN no_marketplace || ' on no shared marketplace' END, CASE WHEN same_family > 0 THEN same_family || ' of a family already in' END,
        CASE WHEN over_mrp > 0 THEN over_mrp || ' over the MRP' END, CASE WHEN reference > 0 THEN reference || ' too far in price or specs' END, CASE WHEN comparable > 0 THEN comparable || ' comparable only' END) END AS shortfall
  FROM (
    SELECT p.product_id, p_size, grade, category, level, coalesce(candidates, 0) AS candidates, coalesce(direct, 0) AS direct, coalesce(comparable, 0) AS comparable, coalesce(reference, 0) AS reference, coalesce(no_marketplace, 0) AS no_marketplace, coalesce(over_mrp, 0) AS over_mrp, coalesce(same_family, 0) AS same_family
    FROM product p LEFT JOIN coverage USING (product_id)))"""


def _det(m: list[list[str]]) -> str:
    """Determinant of a 3 x 3 matrix of expressions."""
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_RIDGE = "0.000001::DOUBLE"
_N = "(n + 0.000001::DOUBLE)"
_MATRIX = [["p0", "r01", "r02"], ["r01", "p1", "r12"], ["r02", "r12", "p2"]]
_CRAMER = ", ".join(f"{_det([[f'g{i}' if j == k else _MATRIX[i][j] for j in range(3)] for i in range(3)])} / {_det(_MATRIX)} AS b{k}" for k in range(3))
_FIT = f"""
moments AS (
  SELECT product_id, count(*) AS n, avg(ln(c_price::DOUBLE)) AS my, var_pop(ln(c_price::DOUBLE)) AS vy, any_value(size)::DOUBLE AS t0, any_value(grade)::DOUBLE AS t1, any_value(tier)::DOUBLE AS t2,
    avg(c_size) AS m0, avg(c_grade) AS m1, avg(c_tier) AS m2, stddev_pop(c_size) AS d0, stddev_pop(c_grade) AS d1, stddev_pop(c_tier) AS d2,
    covar_pop(c_size, ln(c_price::DOUBLE)) AS y0, covar_pop(c_grade, ln(c_price::DOUBLE)) AS y1, covar_pop(c_tier, ln(c_price::DOUBLE)) AS y2, covar_pop(c_size, c_grade) AS c01, covar_pop(c_size, c_tier) AS c02, covar_pop(c_grade, c_tier) AS c12,
    count(DISTINCT c_size) > 1 AS v0, count(DISTINCT c_grade) > 1 AND count(c_grade) = count(*) AND any_value(grade) IS NOT NULL AS v1, count(DISTINCT c_tier) > 1 AS v2
  FROM member GROUP BY product_id),
strengths AS (SELECT product_id, unnest([0, 1, 2]) AS f, unnest([v0, v1, v2]) AS v, unnest([abs(y0) / (d0 * sqrt(vy)), abs(y1) / (d1 * sqrt(vy)), abs(y2) / (d2 * sqrt(vy))]) AS s, n, vy FROM moments WHERE n >= 5),
picked AS (
  SELECT product_id, coalesce(bool_or(f = 0), false) AS u0, coalesce(bool_or(f = 1), false) AS u1, coalesce(bool_or(f = 2), false) AS u2, count(*) AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN vy = 0 THEN 0 ELSE round(s / 0.000000001::DOUBLE) END DESC, f) AS place FROM strengths WHERE v) WHERE place <= greatest(1, (n - 2) // 2) GROUP BY product_id),
system AS (
  SELECT m.*, k, u0, u1, u2, CASE WHEN u0 THEN {_N} ELSE 1 END AS p0, CASE WHEN u1 THEN {_N} ELSE 1 END AS p1, CASE WHEN u2 THEN {_N} ELSE 1 END AS p2,
    CASE WHEN u0 AND u1 THEN n * c01 / (d0 * d1) ELSE 0 END AS r01, CASE WHEN u0 AND u2 THEN n * c02 / (d0 * d2) ELSE 0 END AS r02, CASE WHEN u1 AND u2 THEN n * c12 / (d1 * d2) ELSE 0 END AS r12,
    CASE WHEN u0 THEN n * y0 / d0 ELSE 0 END AS g0, CASE WHEN u1 THEN n * y1 / d1 ELSE 0 END AS g1, CASE WHEN u2 THEN n * y2 / d2 ELSE 0 END AS g2
  FROM moments m JOIN picked USING (product_id)),
solved AS (SELECT *, n * my / {_N} AS b, {_CRAMER} FROM system),
fits AS (
  SELECT product_id, m.n, coalesce(k, 0) AS features, {_h('adjusted * 1000')} AS adjusted_r2_milli, predicted, coalesce(adjusted >= 0.5::DOUBLE AND predicted > 0, false) AS trusted
  FROM moments m LEFT JOIN (
    SELECT product_id, k, 1 - (1 - CASE WHEN vy = 0 THEN 0 ELSE 1 - (n * (my - b) * (my - b) + n * vy - 2 * (b0 * g0 + b1 * g1 + b2 * g2) + b0 * (b0 * (p0 - {_RIDGE}) + b1 * r01 + b2 * r02) + b1 * (b0 * r01 + b1 * (p1 - {_RIDGE}) + b2 * r12) + b2 * (b0 * r02 + b1 * r12 + b2 * (p2 - {_RIDGE}))) / (n * vy) END) * (n - 1) / (n - k - 1) AS adjusted,
      {_h('exp(least(b + CASE WHEN u0 THEN (t0 - m0) / d0 * b0 ELSE 0 END + CASE WHEN u1 THEN (t1 - m1) / d1 * b1 ELSE 0 END + CASE WHEN u2 THEN (t2 - m2) / d2 * b2 ELSE 0 END, 40))')} AS predicted
    FROM solved) USING (product_id))"""


def _snap(p: str, low: str, high: str) -> str:
    """A charm price between two bounds: the grid point under ``p`` less a rupee, moved up to ``low`` (a few steps, as ``p`` lies between the bounds), else ``high``."""
    step = f"CASE WHEN {p} < 100000 THEN 1000 WHEN {p} < 1000000 THEN 5000 ELSE 10000 END"
    tried = f"list_transform(range(0, 5), lambda k: greatest({p} // ({step}) * ({step}) - 100, 100) + k * ({step}))"
    return f"coalesce(list_filter({tried}, lambda x: x >= {low} AND x <= {high})[1], {high})"


_STRATEGIES = f"""{_FIT.strip()},
gate AS (
  SELECT *, CASE WHEN trusted THEN {_h('least(greatest(predicted - comp_median, -0.25::DOUBLE * anchor), 0.25::DOUBLE * anchor)')} ELSE 0 END AS worth,
    CASE evidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium-high' THEN 0.8::DOUBLE WHEN 'medium' THEN 0.55::DOUBLE WHEN 'low' THEN 0.35::DOUBLE ELSE 0.5::DOUBLE END AS travel
  FROM anchors JOIN bounds USING (product_id) JOIN evidence USING (product_id) JOIN (SELECT product_id, direct + comparable AS n_members FROM coverage) USING (product_id) LEFT JOIN (SELECT product_id, coalesce(trusted, false) AS trusted, predicted FROM fits) USING (product_id)
  WHERE n_members >= 3 AND NOT conflict),
raws AS (
  SELECT *, greatest(least({_h('own_min * 0.985::DOUBLE')}, anchor), {_h('anchor * 0.85::DOUBLE')}) AS raw_fast, {_h('anchor + worth * travel * 0.6::DOUBLE')} AS raw_balanced,
    CASE WHEN worth > 0 THEN least(greatest(own_max, anchor) + {_h('worth * travel')}, {_h('own_median * 1.25::DOUBLE')}) ELSE least(greatest(own_max, anchor), greatest({_h('own_median')}, own_max, anchor)) END AS raw_premium
  FROM gate),
fasts AS (SELECT *, SNAP_FAST AS fast FROM (SELECT *, least(greatest(raw_fast, floor), ceiling) AS p1 FROM raws)),
balances AS (SELECT *, SNAP_BALANCED AS balanced FROM (SELECT *, least(greatest(raw_balanced, lifted), ceiling) AS p2 FROM (SELECT *, greatest(floor, fast) AS lifted FROM fasts))),
strategies AS (SELECT *, SNAP_PREMIUM AS premium FROM (SELECT *, least(greatest(raw_premium, balanced), ceiling) AS p3 FROM balances))""".replace("SNAP_FAST", _snap("p1", "floor", "ceiling")).replace("SNAP_BALANCED", _snap("p2", "lifted", "ceiling")).replace("SNAP_PREMIUM", _snap("p3", "balanced", "ceiling"))
_RATIONALE = f"""told AS (
  SELECT s.*, high AS pool_high, own_n = 1 AS single, CASE WHEN worth > 0 THEN 'attributes add ' || {{worth}} || ', of which ' WHEN worth < 0 THEN 'attributes take off ' || {{worth}} || ', of which ' END AS paid
  FROM strategies s LEFT JOIN (SELECT product_id, high FROM zones) USING (product_id))
SELECT product_id, 'fast' AS strategy, fast AS price, concat_ws('; ', CASE WHEN single THEN 'just under the only offer of this product in stock, ' || {{own_min}} ELSE 'just under the cheapest of ' || own_n || ' offers of this product in stock, ' || {{own_min}} END,
  CASE WHEN break_even_floor IS NULL THEN 'no cost is known, so only the market bounds it' ELSE 'never under break-even, ' || {{break_even_floor}} END, 'held by the ' || replace({{raw_fast}}, '_', ' ')) AS messages FROM told
UNION ALL SELECT product_id, 'balanced', balanced, concat_ws('; ', 'anchored at ' || {{anchor}} || CASE WHEN own_n >= 2 THEN ': ' || own_n || ' offers of this product, with its usual price ' || {{normal}} ELSE ': the one offer of this product, with the comparables'' median ' || {{comp_median}} END,
  coalesce(paid || {_h('travel * 60')} || '% counts', 'attributes add nothing that the market can be shown to pay for'),
  CASE distortion WHEN 'normal' THEN 'the market is within a tenth of its usual price' ELSE 'the market is ' || CASE distortion WHEN 'depressed' THEN 'low: ' ELSE 'high: ' END || {{own_median}} || ' against a usual ' || {{normal}} END, 'held by the ' || replace({{raw_balanced}}, '_', ' ')) FROM told
UNION ALL SELECT product_id, 'premium', premium, concat_ws('; ', CASE WHEN single THEN 'starts from what the one offer in stock achieves, ' || {{own_max}} ELSE 'starts from the dearest of ' || own_n || ' offers in stock, ' || {{own_max}} END,
  CASE WHEN pool_high > greatest(own_max, anchor) THEN 'the upper quartile of comparables, ' || {{pool_high}} || ', is dearer and isn''t used' END, CASE WHEN worth > 0 THEN paid || {_h('travel * 100')} || '% counts' ELSE 'attributes add nothing that the market can be shown to pay for' END,
  CASE WHEN worth > 0 AND raw_premium >= {_h('own_median * 1.25::DOUBLE')} THEN 'capped at 25% over this product''s median of ' || {{own_median}} END, 'held by the ' || replace({{raw_premium}}, '_', ' ')) FROM told"""
_BOUND = "CASE WHEN {0} > ceiling THEN 'ceiling: ' || ceiling_source WHEN {0} < floor THEN 'floor: ' || CASE WHEN break_even_floor >= market_floor THEN 'break_even' ELSE 'market' END END"


def _money(c: str) -> str:
    """Whole rupees of a price in minor units, grouped by three digits and then by pairs."""
    q = f"CAST({_h(f'abs({c}) / 100')} AS VARCHAR)"
    return f"'₹' || CASE WHEN len({q}) <= 3 THEN {q} ELSE ltrim(reverse(regexp_replace(reverse(({q})[:-4]), '(..)', '\\1,', 'g')), ',') || ',' || ({q})[-3:] END"


for _c in ("own_min", "own_max", "break_even_floor", "anchor", "normal", "comp_median", "own_median", "pool_high", "worth"):
    _RATIONALE = _RATIONALE.replace("{" + _c + "}", _money(_h(f"{_c}::DOUBLE")))
for _c in ("raw_fast", "raw_balanced", "raw_premium"):
    _RATIONALE = _RATIONALE.replace("{" + _c + "}", _BOUND.format(_c))


def _sql(body: str, recommend: bool = False) -> str:
    return f"WITH RECURSIVE {_ROLES.strip()}" + (f",\n{_RECOMMEND.strip()}" if recommend else "") + f"\n{body}"


_BUT = {g: " AND ".join(f"ok_{x}" for x in ("brand", "price", "rating", "market", "stock", "specs") if x != g) for g in ("brand", "price", "rating", "market", "stock", "specs", None)}
_SORTS = {"relevance": "review_count DESC", "reviews": "review_count DESC", "price_asc": "min_price ASC NULLS LAST", "price_desc": "min_price DESC NULLS LAST", "rating": "rating_tenths DESC NULLS LAST", "recent": "first_seen_at DESC"}
_WPRICE = "wprice AS (SELECT product_id, product_type, universal_effective, product_id % 5 AS weight FROM price JOIN product USING (product_id))"
_STEP = "CASE WHEN p < 100000 THEN 1000 WHEN p < 1000000 THEN 5000 ELSE 10000 END"
_NET = f"selling - {_h('selling * referral_bp / 10000')} - fixed_fee * 100 - shipping - {_h('(%s + fixed_fee * 100 + shipping) * 18 / 100' % _h('selling * referral_bp / 10000'))}"
_SPEC_LONG = "long_spec AS (SELECT product_id, 'size' AS attribute_key, 0 AS ord, CAST(p_size AS VARCHAR) AS value, CASE WHEN p_size < 10 THEN 'up to 10' WHEN p_size < 25 THEN '10 to 25' ELSE '25 and more' END AS option FROM product UNION ALL SELECT product_id, 'grade', 1, CAST(grade AS VARCHAR), CAST(grade AS VARCHAR) FROM product WHERE grade IS NOT NULL UNION ALL SELECT product_id, 'material', 2, category, category FROM product UNION ALL SELECT product_id, 'large', 3, CASE WHEN p_size > 25 THEN '1' END, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END FROM product)"



def _short(c: str) -> str:
    """Rupees with a suffix: 2.5k, 1L."""
    plain = lambda x: f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"
    return f"CASE WHEN {c} >= 100000 THEN {plain(f'{c} / 100000')} || 'L' WHEN {c} >= 1000 THEN {plain(f'{c} / 1000')} || 'k' ELSE CAST({c} AS VARCHAR) END"


def _browse(tail: str, scope: str, ok: dict[str, str], specs: str, typed: str | None = None) -> str:
    """A catalogue page the plain way: each group's predicate by itself, and a pool for each facet. ``specs`` holds only where there is one product type."""
    test = {g: ok.get(g, "true") for g in ("brand", "price", "rating", "market", "stock")}
    flags = ", ".join(f"coalesce({v}, false) AS ok_{g}" for g, v in test.items())
    kind = f"'{typed}' AS product_type" if typed else "CASE WHEN min(product_type) = max(product_type) THEN min(product_type) END AS product_type FROM scope"
    return _sql(f""", scope AS (
  SELECT s.*, p_size, grade FROM summary s JOIN (SELECT product_id, p_size, grade FROM product) USING (product_id) WHERE {scope}),
only_type AS (SELECT {kind}),
ladder AS (
  SELECT CASE WHEN top <= 8000 THEN [500, 1000, 2000, 5000] WHEN top <= 16000 THEN [1000, 2500, 5000, 10000] WHEN top <= 64000 THEN [5000, 10000, 20000, 40000] WHEN top <= 160000 THEN [10000, 25000, 50000, 100000] ELSE [25000, 50000, 100000, 200000] END AS edges
  FROM (SELECT max(min_price) / 100 AS top FROM scope) WHERE top IS NOT NULL),
buckets AS (SELECT unnest(range(0, 5)) AS bucket, unnest(list_concat([0], edges)) AS low, unnest(list_concat(edges, [NULL])) AS high FROM ladder),
asked2 AS (
  SELECT *, {flags}, (SELECT product_type FROM only_type) IS NULL OR ({specs}) AS ok_specs
  FROM (SELECT scope.*, bucket FROM scope LEFT JOIN buckets ON min_price >= low * 100 AND (high IS NULL OR min_price < high * 100))),
spec_pool AS (SELECT product_id, p_size, grade, category FROM asked2 WHERE {_BUT['specs']} AND (SELECT product_type FROM only_type) IS NOT NULL),
spec_options AS (
  SELECT 'spec:size' AS facet, CASE WHEN p_size < 10 THEN 'up to 10' WHEN p_size < 25 THEN '10 to 25' ELSE '25 and more' END AS option, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 25 THEN 1 ELSE 2 END AS pos FROM spec_pool
  UNION ALL SELECT 'spec:grade', CAST(grade AS VARCHAR), NULL FROM spec_pool WHERE grade IS NOT NULL UNION ALL SELECT 'spec:material', category, NULL FROM spec_pool UNION ALL SELECT 'spec:large', CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END, CASE WHEN p_size > 25 THEN 0 ELSE 1 END FROM spec_pool),
facets AS (
  SELECT 'brand' AS facet, brand AS option, brand AS label, NULL AS pos, count(*) AS n FROM asked2 WHERE {_BUT['brand']} GROUP BY brand
  UNION ALL SELECT 'price', CAST(bucket AS VARCHAR), CASE WHEN low = 0 THEN 'Under ₹' || h WHEN high IS NULL THEN '₹' || l || ' & above' ELSE '₹' || l || ' – ₹' || h END, bucket, n FROM (
    SELECT *, {_short('low')} AS l, {_short('high')} AS h FROM buckets JOIN (SELECT bucket, count(*) AS n FROM asked2 WHERE {_BUT['price']} GROUP BY bucket) USING (bucket))
  UNION ALL SELECT 'rating', option, label, pos, count(*) FROM asked2, (VALUES ('r4', '4★ & above', 40, 0), ('r35', '3.5★ & above', 35, 1), ('r3', '3★ & above', 30, 2)) o(option, label, least_rating, pos) WHERE {_BUT['rating']} AND coalesce(rating_tenths, 0) >= least_rating GROUP BY ALL
  UNION ALL SELECT 'marketplace', CAST(m AS VARCHAR), CAST(m AS VARCHAR), m, count(*) FROM (SELECT unnest(marketplaces) AS m FROM asked2 WHERE {_BUT['market']}) GROUP BY m
  UNION ALL SELECT 'availability', 'in_stock', 'In stock', 0, count(*) FROM asked2 WHERE {_BUT['stock']} AND any_in_stock
  UNION ALL SELECT facet, option, CASE option WHEN 'true' THEN 'Yes' WHEN 'false' THEN 'No' ELSE option END, any_value(pos), count(*) FROM spec_options WHERE facet IN (SELECT facet FROM spec_options GROUP BY facet HAVING count(DISTINCT option) > 1) GROUP BY facet, option)
{tail}""")


_FACETS = "SELECT facet, option, label, n, row_number() OVER (PARTITION BY facet ORDER BY CASE WHEN pos IS NULL THEN -n ELSE pos END, option) AS place FROM facets"
_RESULTS = f"SELECT row_number() OVER (ORDER BY %s, product_id) AS place, product_id, canonical_name, brand, min_price, max_price, rating_tenths, review_count, listings, any_in_stock FROM asked2 WHERE {_BUT[None]}"
_MIXED = {
    "scope": "s.product_id IN (SELECT product_id FROM offer JOIN seller USING (seller_id, marketplace_id) WHERE marketplace_id = 1)", "specs": "p_size >= 10 AND p_size < 25",
    "ok": {"brand": "brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7')", "market": "list_has_any(marketplaces, [0, 1, 2, 3])", "price": "bucket IN (2, 3, 4)"},
}
_TYPED = {"scope": "product_type = 'hot plate'", "typed": "hot plate", "specs": "p_size >= 10 AND category IN ('SMALL', 'LARGE', 'PROMO') AND coalesce(grade BETWEEN 1 AND 4, false)", "ok": {"stock": "any_in_stock", "rating": "coalesce(rating_tenths, 0) >= 30", "price": "bucket IN (1, 2, 3, 4)"}}
_SINGLE = {
    "scope": "contains(lower(canonical_name), 'hot plate') OR contains(lower(brand), 'hot plate') OR contains(lower(product_type), 'hot plate')", "specs": "p_size >= 10 AND p_size > 25",
    "ok": {"brand": "brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22')", "market": "list_has_any(marketplaces, [1, 2])"},
}
_SELLER = {"scope": "s.product_id IN (SELECT product_id FROM offer WHERE seller_id = 3)", "specs": "p_size >= 10 AND p_size < 25", "ok": {"stock": "any_in_stock"}}
_ADDRESS = {
    "scope": "contains(lower(canonical_name), 'brand#1') OR contains(lower(brand), 'brand#1') OR contains(lower(product_type), 'brand#1')", "specs": "p_size >= 10",
    "ok": {"brand": "brand IN ('Brand#1', 'Brand#12')", "price": "bucket IN (1, 2, 3)", "rating": "coalesce(rating_tenths, 0) >= 30", "market": "list_has_any(marketplaces, [0, 2])", "stock": "any_in_stock"},
}


def _envelope(name: str, request: dict, breadcrumb: str, children: str, types: str) -> str:
    """One request's envelope, as a statement of its own in brackets."""
    tail = f"SELECT '{name}' AS request, (SELECT count(*) FROM asked2 WHERE {_BUT[None]}) AS total, (SELECT count(*) FROM scope) AS scope_total, (SELECT product_type FROM only_type) AS product_type, {breadcrumb} AS breadcrumb, ({children}) AS children, ({types}) AS types"
    return "(" + _browse(tail, **request).replace("\n, ", ",\n", 1) + ")"


_ROOTS = "SELECT string_agg(id, ',' ORDER BY id) FROM tree WHERE parent_id IS NULL"

ORACLE_SQL = {
    "current_effective_price": _sql("SELECT product_id, universal_effective, listing_id, offer_id, landed, conditional_best, universal_discount, marketplace_id, seller_id FROM price"),
    "join_chain": _sql("SELECT p.product_id, product_type, l.listing_id, l.marketplace_id, confidence_pct, human_confirmed, count(*) AS offers FROM product p JOIN listing l USING (product_id) JOIN offer o ON o.listing_id = l.listing_id GROUP BY ALL"),
    "latest_observation": _sql("SELECT offer_id, listing_id, product_id, marketplace_id, seller_id, observed_at, seq, selling, shipping, mrp, in_stock, sale_label FROM state"),
    "price_layers": _sql("SELECT offer_id, listing_id, product_id, marketplace_id, seller_id, observed_at, seq, selling, shipping, mrp, in_stock, landed, deferred_benefit, financing_benefit, universal_discount, universal_effective, conditional_discount, conditional_best, below_mrp_bp FROM state"),
    "price_ladder_rows": _sql("SELECT offer_id, rung, label, amount FROM (" + " UNION ALL ".join(f"SELECT offer_id, {k} AS rung, '{c}' AS label, {c} AS amount, {k in (1, 2, 4, 6, 8)} AS always FROM state" for k, c in enumerate(("mrp", "selling", "shipping", "landed", "universal_discount", "universal_effective", "conditional_discount", "conditional_best", "deferred_benefit", "financing_benefit"), 1)) + ") WHERE always OR amount > 0"),
    "commercial_state": _sql(f"SELECT offer_id, seller_id, rating_tenths, in_stock, universal_effective, is_default AS is_category_default, {_NET} AS net, {_NET} - cost AS margin FROM state JOIN (SELECT product_id, category FROM product) USING (product_id) LEFT JOIN rule_for USING (marketplace_id, category) LEFT JOIN last_rating USING (seller_id) LEFT JOIN seller_cost USING (product_id)"),
    "effective_price_asof": _sql("SELECT product_id, min(universal_effective) AS price_asof FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY observed_at DESC, seq DESC, selling DESC, shipping DESC, mrp DESC) AS rn FROM laddered WHERE in_stock AND observed_at <= DATE '1998-01-01') WHERE rn = 1 GROUP BY product_id"),
    "product_price_series": _sql("SELECT * FROM series"),
    "history_stats": _sql(f"SELECT *, {_h('(current_price - first_price) * 10000 / first_price')} AS trend_bp, {_h('(current_price - lowest) * 10000 / lowest')} AS above_low_bp FROM history"),
    "buybox_winner": _sql("SELECT listing_id, observed_at, offer_id, landed FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, observed_at ORDER BY landed, offer_id) AS n FROM seen WHERE in_stock) WHERE n = 1"),
    "sale_windows": _sql("SELECT product_id, min(observed_at) AS window_start, max(observed_at) AS window_end, min_by(sale_label, observed_at) AS label, count(*) AS days FROM (SELECT *, n - row_number() OVER (PARTITION BY product_id ORDER BY observed_at) AS island FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY observed_at) AS n FROM series) WHERE sale_label IS NOT NULL) GROUP BY product_id, island"),
    "recent_rows": _sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY observed_at DESC) AS back FROM series) WHERE back <= 30"),
    "merged_price_grid": _sql("SELECT listing_id, observed_at, count(*) AS offers, count_if(in_stock) AS in_stock_offers, min(universal_effective) FILTER (in_stock) AS least_price, max(universal_effective) FILTER (in_stock) AS most_price, arg_max(sale_label, offer_id) FILTER (sale_label IS NOT NULL) AS sale_label, arg_max(mrp, offer_id) AS mrp FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, observed_at, offer_id ORDER BY seq DESC, selling DESC, shipping DESC, mrp DESC, in_stock DESC) AS n FROM seen) WHERE n = 1 GROUP BY listing_id, observed_at"),
    "merged_price_offers": _sql("SELECT listing_id, observed_at, offer_id, CASE WHEN in_stock THEN universal_effective END AS price FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, observed_at, offer_id ORDER BY seq DESC, selling DESC, shipping DESC, mrp DESC, in_stock DESC) AS n FROM seen) WHERE n = 1"),
    "listing_history_summary": _sql(f"SELECT listing_id, min(low) AS low, max(high) AS high, {_h('sum(f) / count(*)')} AS mean_first, {_h('sum(l) / count(*)')} AS mean_last, {_h('(sum(l) - sum(f)) * 10000 / sum(f)')} AS change_bp FROM (SELECT listing_id, offer_id, min(universal_effective) FILTER (in_stock) AS low, max(universal_effective) FILTER (in_stock) AS high, arg_min(universal_effective, (observed_at, seq, selling, shipping, mrp, in_stock)) AS f, arg_max(universal_effective, (observed_at, seq, selling, shipping, mrp, in_stock)) AS l FROM seen GROUP BY listing_id, offer_id) GROUP BY listing_id"),
    "tracked_summary": _sql("SELECT * FROM track"),
    "price_alerts": _sql("SELECT product_id, change, change_bp, CASE WHEN change_bp <= -400 THEN 'drop' ELSE 'rise' END AS alert FROM track WHERE change_bp <= -400 OR change_bp >= 400"),
    "portfolio_position": _sql(f"SELECT (SELECT count(*) FROM tracked) AS tracked, (SELECT count(DISTINCT marketplace_id) FROM listing JOIN tracked USING (product_id)) AS marketplaces, coalesce({_h('(SELECT avg(change_bp) FROM track)')}, 0) AS mean_change_bp"),
    "fee_rule_asof": _sql("SELECT marketplace_id, category, listing_id, is_default AS is_category_default, referral_bp, fixed_fee FROM listing JOIN (SELECT product_id, category FROM product) USING (product_id) LEFT JOIN rule_for USING (marketplace_id, category)"),
    "net_realization": _sql(f"SELECT offer_id, {_h('selling * referral_bp / 10000')} AS referral, {_h('(%s + fixed_fee * 100 + shipping) * 18 / 100' % _h('selling * referral_bp / 10000'))} AS gst, {_NET} AS net FROM state JOIN (SELECT product_id, category FROM product) USING (product_id) LEFT JOIN rule_for USING (marketplace_id, category)"),
    "break_even": _sql("SELECT * FROM be", True),
    "strategy_margins": _sql(f"SELECT product_id, 'current' AS strategy, marketplace_id, price, margin, {_h('margin * 10000 / price')} AS margin_bp FROM (SELECT *, price - ref - fixed_fee * 100 - {_h('(ref + fixed_fee * 100) * 18 / 100')} - cost AS margin FROM (SELECT product_id, r.marketplace_id, universal_effective AS price, cost, fixed_fee, {_h('universal_effective * referral_bp / 10000')} AS ref FROM (SELECT product_id, universal_effective FROM price) JOIN seller_cost USING (product_id) JOIN product USING (product_id) JOIN rule_for r USING (category)))"),
    "review_metrics": _sql("SELECT * FROM metrics"),
    "review_velocity": _sql("SELECT * FROM velocity"),
    "seller_latest_rating": _sql("SELECT seller_id, captured_at, rating_tenths, rating_count FROM last_rating"),
    "seller_group_members": _sql("SELECT a.seller_id, b.seller_id AS member_id FROM seller a JOIN seller b USING (seller_group) WHERE a.seller_id <> b.seller_id"),
    "marketplace_comparison": _sql(f"""SELECT listing_id, offers, price, offer_id, net, rating_tenths, review_count, velocity_milli, cheapest, gap, coalesce(listing_id = last, false) AS is_cheapest FROM (
      SELECT *, max(CASE WHEN price = cheapest THEN listing_id END) OVER (PARTITION BY product_id) AS last FROM (
        SELECT *, min(price) OVER (PARTITION BY product_id) AS cheapest, coalesce(max(price) OVER (PARTITION BY product_id) - min(price) OVER (PARTITION BY product_id), 0) AS gap FROM (
          SELECT s.*, {_NET} AS net FROM (SELECT listing_id, product_id, marketplace_id, count(*) AS offers, min(universal_effective) FILTER (in_stock) AS price, arg_min(offer_id, (universal_effective, offer_id)) FILTER (in_stock) AS offer_id, arg_min(selling, (universal_effective, offer_id)) FILTER (in_stock) AS selling, arg_min(shipping, (universal_effective, offer_id)) FILTER (in_stock) AS shipping FROM state GROUP BY ALL) s
          JOIN (SELECT product_id, category FROM product) USING (product_id) LEFT JOIN rule_for USING (marketplace_id, category)))) LEFT JOIN (SELECT listing_id, rating_tenths, review_count, velocity_milli FROM velocity) USING (listing_id)"""),
    "product_summary": _sql("SELECT * REPLACE (array_to_string(marketplaces, ',') AS marketplaces) FROM summary"),
    "search_catalogue": _sql(f"SELECT product_id, canonical_name, min_price, rating_tenths, review_count FROM asked WHERE {_BUT[None]}"),
    "search_products": _sql("SELECT product_id, canonical_name, brand, coalesce(n, 0) AS listings, universal_effective AS price, rating_tenths FROM product LEFT JOIN (SELECT product_id, count(*) AS n FROM listing GROUP BY product_id) USING (product_id) LEFT JOIN (SELECT product_id, universal_effective FROM price) USING (product_id) LEFT JOIN (SELECT product_id, rating_tenths FROM metrics) USING (product_id) WHERE contains(lower(canonical_name), 'blue') AND category = 'SMALL'"),
    "catalogue_sorted": _sql(" UNION ALL ".join(f"SELECT '{k}' AS sort, place, product_id FROM (SELECT product_id, row_number() OVER (ORDER BY {o}, product_id) AS place FROM summary) WHERE place <= 20" for k, o in _SORTS.items())),
    "catalogue_sorted_whole": _sql(" UNION ALL ".join(f"SELECT '{k}' AS sort, row_number() OVER (ORDER BY {o}, product_id) AS place, product_id FROM summary" for k, o in _SORTS.items())),
    "price_buckets": _sql("""SELECT bucket, low * 100 AS low, high * 100 AS high, (SELECT count(*) FROM summary WHERE min_price >= low * 100 AND (high IS NULL OR min_price < high * 100)) AS n FROM (
      SELECT unnest(range(0, 5)) AS bucket, unnest(list_concat([0], edges)) AS low, unnest(list_concat(edges, [NULL])) AS high FROM (
        SELECT CASE WHEN top <= 8000 THEN [500, 1000, 2000, 5000] WHEN top <= 16000 THEN [1000, 2500, 5000, 10000] WHEN top <= 64000 THEN [5000, 10000, 20000, 40000] WHEN top <= 160000 THEN [10000, 25000, 50000, 100000] ELSE [25000, 50000, 100000, 200000] END AS edges FROM (SELECT max(min_price) / 100 AS top FROM summary)))"""),
    "facet_brand": _sql(f"SELECT brand, count(*) AS n FROM asked WHERE {_BUT['brand']} GROUP BY brand"),
    "facet_price": _sql(f"SELECT CASE WHEN min_price < 1000000 THEN 0 WHEN min_price < 2500000 THEN 1 WHEN min_price < 5000000 THEN 2 WHEN min_price < 10000000 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM asked WHERE {_BUT['price']} AND min_price >= 0 GROUP BY bucket"),
    "facet_rating": _sql(f"SELECT option, count(*) AS n FROM asked, (VALUES ('r4', 40), ('r35', 35), ('r3', 30)) o(option, least_rating) WHERE {_BUT['rating']} AND coalesce(rating_tenths, 0) >= least_rating GROUP BY option"),
    "facet_marketplace": _sql(f"SELECT marketplace_id, count(*) AS n FROM (SELECT unnest(marketplaces) AS marketplace_id FROM asked WHERE {_BUT['market']}) GROUP BY marketplace_id"),
    "facet_availability": _sql(f"SELECT count_if(any_in_stock) AS in_stock FROM asked WHERE {_BUT['stock']}"),
    "facet_specs": _sql(f"SELECT attribute_key, option, n FROM (SELECT *, count(*) OVER (PARTITION BY attribute_key) AS k FROM (SELECT attribute_key, option, count(*) AS n FROM long_spec JOIN asked USING (product_id) WHERE {_BUT['specs']} GROUP BY ALL)) WHERE k > 1").replace("\nSELECT attribute_key", f",\n{_SPEC_LONG}\nSELECT attribute_key", 1),
    "key_specs": _sql("SELECT product_id, place, attribute_key, value FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ord) AS place FROM long_spec WHERE value IS NOT NULL) WHERE place <= 3").replace("\nSELECT product_id, place", f",\n{_SPEC_LONG}\nSELECT product_id, place", 1),
    "category_path": _sql(", walk AS (SELECT id, level, name AS path FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, t.level, w.path || '/' || t.name FROM tree t JOIN walk w ON t.parent_id = w.id) SELECT * FROM walk"),
    "category_subtree": _sql(", under AS (SELECT id AS ancestor, id FROM tree UNION ALL SELECT u.ancestor, t.id FROM under u JOIN tree t ON t.parent_id = u.id) SELECT * FROM under"),
    "taxonomy_counts": _sql(", under AS (SELECT id AS ancestor, id FROM tree UNION ALL SELECT u.ancestor, t.id FROM under u JOIN tree t ON t.parent_id = u.id) SELECT ancestor AS id, count(offer_id) AS offers FROM under LEFT JOIN offer ON under.id = 's' || seller_id GROUP BY ancestor"),
    "marketplace_category_map": _sql("SELECT r_regionkey AS marketplace_id, category, EXISTS (SELECT 1 FROM listing l JOIN product p USING (product_id) WHERE l.marketplace_id = r_regionkey AND p.category = c.category) AS mapped FROM region, (SELECT DISTINCT category FROM product) c"),
    "catalogue_request": _browse(_RESULTS % "min_price DESC NULLS LAST", **_MIXED),
    "catalogue_typed": _browse(_RESULTS % "review_count DESC", **_TYPED),
    "catalogue_single": _browse(_RESULTS % "coalesce(rating_tenths, 0) DESC", **_SINGLE),
    "catalogue_facets": _browse(_FACETS, **_MIXED),
    "catalogue_facets_typed": _browse(_FACETS, **_TYPED),
    "catalogue_facets_single": _browse(_FACETS, **_SINGLE),
    "catalogue_envelope": " UNION ALL ".join((
        _envelope("mixed", _MIXED, "'r1'", "SELECT string_agg(id, ',' ORDER BY id) FROM tree WHERE parent_id = 'r1'", "SELECT ''"), _envelope("typed", _TYPED, "''", _ROOTS, "SELECT ''"), _envelope("single", _SINGLE, "''", _ROOTS, "SELECT ''"),
        _envelope("seller", _SELLER, "(SELECT 'r' || n_regionkey || ',n' || n_nationkey || ',s3' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 3)", "SELECT ''", "SELECT string_agg(DISTINCT product_type, ',' ORDER BY product_type) FROM offer JOIN product USING (product_id) WHERE seller_id = 3"),
    )),
    "departments": _sql(", walk AS (SELECT id, id AS department, name AS department_name, 1 AS depth FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, w.department, w.department_name, w.depth + 1 FROM tree t JOIN walk w ON t.parent_id = w.id) SELECT *, false AS cyclic FROM walk"),
    "taxonomy_products": _sql(", under AS (SELECT id AS ancestor, id FROM tree UNION ALL SELECT u.ancestor, t.id FROM under u JOIN tree t ON t.parent_id = u.id) SELECT ancestor AS id, count(DISTINCT product_id) AS products FROM under LEFT JOIN offer ON under.id = 's' || seller_id GROUP BY ancestor UNION ALL SELECT 't:' || product_type, count(*) FROM product GROUP BY product_type"),
    "rendered_specs": _sql("SELECT product_id, 'size' AS attribute_key, p_size || ' cm' AS shown FROM product UNION ALL SELECT product_id, 'grade', CAST(grade AS VARCHAR) FROM product WHERE grade IS NOT NULL UNION ALL SELECT product_id, 'material', category FROM product UNION ALL SELECT product_id, 'large', CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END FROM product"),
    "listing_offers": _sql("SELECT s.listing_id, offer_id, seller_id, in_stock, landed, universal_effective, row_number() OVER (PARTITION BY s.listing_id ORDER BY universal_effective, offer_id) AS place, v.rating_tenths, review_count, velocity_milli FROM state s LEFT JOIN velocity v ON v.listing_id = s.listing_id"),
    "product_detail": _sql("SELECT p.product_id, canonical_name, brand, product_type, c.universal_effective AS price, coalesce(n, 0) AS listings, (SELECT count(*) - 1 FROM product q WHERE q.identity_id = p.identity_id) AS siblings, (SELECT min(universal_effective) FROM product q JOIN price x ON x.product_id = q.product_id WHERE q.identity_id = p.identity_id AND q.product_id <> p.product_id) AS least_sibling_price FROM product p LEFT JOIN price c ON c.product_id = p.product_id LEFT JOIN (SELECT product_id, count(*) AS n FROM listing GROUP BY product_id) l ON l.product_id = p.product_id"),
    "product_pages": _sql(f"""SELECT p.product_id, canonical_name, brand, product_type, identity_id, c.universal_effective AS price, category_path,
      CASE WHEN p.product_id % 11 <> 0 THEN 'size:Size:cm,grade:Grade:-,material:Material:-,large:Large:-' ELSE 'size:Size:cm,material:Material:-,large:Large:-' END AS attributes, coalesce(l.listings, '') AS listings
      FROM product p LEFT JOIN (SELECT product_id, universal_effective FROM price) c USING (product_id) LEFT JOIN (
        SELECT product_id, r_name || '/' || n_name || '/' || s_name AS category_path FROM (SELECT product_id, min(seller_id) AS s FROM offer GROUP BY product_id) JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey) USING (product_id)
      LEFT JOIN (SELECT l.product_id, string_agg(concat_ws(':', l.listing_id, r_name, coalesce(CAST(rating_tenths AS VARCHAR), '-'), coalesce(CAST(review_count AS VARCHAR), '-'), coalesce(CAST(universal_effective AS VARCHAR), '-')), ',' ORDER BY l.listing_id) AS listings
        FROM listing l JOIN region ON r_regionkey = l.marketplace_id LEFT JOIN (SELECT listing_id, rating_tenths, review_count FROM velocity) v USING (listing_id) LEFT JOIN (SELECT product_id, universal_effective FROM price) x ON x.product_id = l.product_id GROUP BY l.product_id) l USING (product_id)"""),
    "variant_families": _sql("SELECT identity_id, product_id, row_number() OVER (PARTITION BY identity_id ORDER BY product_id) AS place, count(*) OVER (PARTITION BY identity_id) - 1 AS siblings, universal_effective AS price FROM product LEFT JOIN (SELECT product_id, universal_effective FROM price) USING (product_id)"),
    "listing_pages": _sql(f""", cards AS (
      SELECT s.*, seller_name, r.rating_tenths AS seller_rating, row_number() OVER w AS place, CASE WHEN mrp <> 0 THEN {_h('(mrp - selling) * 10000 / mrp')} END AS off, in_stock AND row_number() OVER (PARTITION BY listing_id, in_stock ORDER BY universal_effective, offer_id) = 1 AS featured,
        coalesce((SELECT p.availability || 'x1' FROM promotion p WHERE p.offer_id = s.offer_id AND (valid_from IS NULL OR valid_from <= observed_at) AND (valid_to IS NULL OR valid_to >= observed_at)), '') AS promos
      FROM state s JOIN (SELECT seller_id, seller_name FROM seller) USING (seller_id) LEFT JOIN (SELECT seller_id, rating_tenths FROM last_rating) r USING (seller_id) WINDOW w AS (PARTITION BY listing_id ORDER BY universal_effective, offer_id)),
      paged AS (
      SELECT listing_id, max(offer_id) FILTER (featured) AS featured_offer, string_agg(concat_ws(':', place, offer_id, seller_name, coalesce(CAST(seller_rating AS VARCHAR), '-'), in_stock, landed, universal_effective, conditional_best, coalesce(CAST(off AS VARCHAR), '-'), featured, promos), ',' ORDER BY place) AS offers FROM cards GROUP BY listing_id)
      SELECT listing_id, r_name AS marketplace_name, product_id, canonical_name, confidence_pct, rating_tenths, review_count, velocity_milli, featured_offer, offers
      FROM listing JOIN region ON r_regionkey = marketplace_id JOIN (SELECT product_id, canonical_name FROM product) USING (product_id) LEFT JOIN (SELECT listing_id, rating_tenths, review_count, velocity_milli FROM velocity) USING (listing_id) LEFT JOIN paged USING (listing_id)"""),
    "price_histories": _sql("SELECT listing_id, offer_id, seller_name, string_agg(concat_ws(':', observed_at, selling, landed, universal_effective, in_stock), ',' ORDER BY observed_at, seq, selling, landed) AS observations FROM seen JOIN (SELECT seller_id, seller_name FROM seller) USING (seller_id) GROUP BY ALL"),
    "taxonomy_mapping": _sql(r""", profile_of(marketplace_id, prefix, confidence_pct, mapped_by, departments) AS (VALUES (0, 'mk', 95, 'rule', NULL), (1, 'bz', 84, 'model', ['r1', 'r2']), (2, 'tr', 91, 'rule', ['r0', 'r2', 'r4']), (3, 'vd', 94, 'rule', ['r3'])),
      leaf AS (SELECT s_suppkey, n_regionkey, r_name, n_name, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey IN (SELECT seller_id FROM offer)),
      curated AS (SELECT n_regionkey AS marketplace_id, 's' || s_suppkey AS node_id, 'own-' || s_suppkey AS external_node_id, 'Sellers > ' || s_name AS raw_path, 99 AS confidence_pct, 'curator' AS mapped_by FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 = 0),
      capital(x, y) AS (SELECT x, array_to_string(list_transform(string_split(regexp_replace(x, '[-#]+', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') FROM (SELECT r_name AS x FROM region UNION SELECT n_name FROM nation UNION SELECT s_name FROM supplier))
      SELECT * FROM curated UNION ALL SELECT marketplace_id, 's' || s_suppkey, prefix || '-' || lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '-', 'g')) || '-' || lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g')), a.y || ' > ' || b.y || ' > ' || c.y, confidence_pct, mapped_by
      FROM profile_of, leaf JOIN capital a ON a.x = r_name JOIN capital b ON b.x = n_name JOIN capital c ON c.x = s_name WHERE (departments IS NULL OR list_contains(departments, 'r' || n_regionkey)) AND NOT EXISTS (SELECT 1 FROM curated WHERE curated.marketplace_id = profile_of.marketplace_id AND node_id = 's' || s_suppkey)"""),
    "rationales": _sql(f", {_STRATEGIES}, {_RATIONALE}", True),
    "pool_position": _sql(f"SELECT product_id, price, sits_above + 1 AS rank, total + 1 AS of, total, {_h('sits_above * 10000 / total')} AS percentile_bp, undercuts, sits_above FROM (SELECT product_id, price, count(*) AS total, count_if(c_price < price) AS sits_above, count_if(c_price > price) AS undercuts FROM member WHERE price IS NOT NULL GROUP BY ALL)"),
    "variant_siblings": _sql("SELECT a.product_id, b.product_id AS sibling_id FROM product a JOIN product b USING (identity_id) WHERE a.product_id <> b.product_id"),
    "derive_model_name": _sql("SELECT product_id, product_type AS model FROM product"),
    "compact_prices": _sql(f"""SELECT product_id, '₹' || CASE WHEN p >= 10000000 THEN (h // 100) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || 'L' WHEN p >= 100000 THEN (k // 10) || '.' || (k % 10) || 'k' ELSE CAST(q AS VARCHAR) END AS label
      FROM (SELECT product_id, universal_effective AS p, {_h('universal_effective / 100000')} AS h, {_h('universal_effective / 10000')} AS k, {_h('universal_effective / 100')} AS q FROM price)"""),
    "psych_snap": _sql(f", snap AS (SELECT *, {_STEP} AS step FROM (SELECT product_id, universal_effective AS p, {_h('universal_effective * 0.9::DOUBLE')} AS low, {_h('universal_effective * 1.1::DOUBLE')} AS high FROM price)), climb AS (SELECT product_id, p, low, high, step, CAST(greatest(floor(p / step) * step - 100, 100) AS BIGINT) AS x FROM snap UNION ALL SELECT product_id, p, low, high, step, x + step FROM climb WHERE x < low), top AS (SELECT product_id, p, low, high, step, max(x) AS x FROM climb GROUP BY ALL), eased AS (SELECT *, CASE WHEN x > high THEN x - step ELSE x END AS y FROM top) SELECT product_id, p AS universal_effective, CASE WHEN y < low OR y > high THEN high ELSE y END AS snapped FROM eased"),
    "distribution_stats": _sql("SELECT product_type, count(*) AS n, min(universal_effective) AS least, quantile_cont(universal_effective, 0.25) AS q1, quantile_cont(universal_effective, 0.5) AS median, quantile_cont(universal_effective, 0.75) AS q3, max(universal_effective) AS most, quantile_cont(universal_effective, 0.75) - quantile_cont(universal_effective, 0.25) AS iqr FROM price JOIN product USING (product_id) GROUP BY product_type"),
    "weighted_quantile": _sql(f", {_WPRICE}, {_weighted('wd', 'wprice', 'product_type', 'universal_effective', 'weight', 'product_id')} SELECT product_type, wq1, wq2, wq3 FROM wd"),
    "weighted_distribution": _sql(f", {_WPRICE}, {_weighted('wd', 'wprice', 'product_type', 'universal_effective', 'weight', 'product_id')} SELECT *, wq3 - wq1 AS iqr FROM wd"),
    "applicable_mrp": _sql("SELECT * FROM mrp"),
    "competition_stats": _sql("SELECT *, most - least AS spread FROM competition"),
    "price_position": _sql(f"SELECT product_id, price, sits_above + 1 AS rank, n + 1 AS of, {_h('sits_above * 10000 / n')} AS percentile_bp, undercuts, sits_above FROM (SELECT product_id, price, count(*) AS n, count_if(universal_effective < price) AS sits_above, count_if(universal_effective > price) AS undercuts FROM state JOIN (SELECT product_id, {_h('median')} AS price FROM competition) USING (product_id) WHERE in_stock GROUP BY ALL)"),
    "candidate_pairs": _sql("SELECT product_id, count(*) AS candidates, CAST(sum(c) AS BIGINT) AS id_sum FROM compared GROUP BY product_id"),
    "attr_compare": _sql(f"SELECT product_id, c AS c_product_id, {_h('s_size * 1000000')} AS size, {_h('s_grade * 1000000')} AS grade, s_material * 1000000 AS material, s_large * 1000000 AS large FROM compared WHERE product_id < c"),
    "spec_similarity": _sql(f"SELECT product_id, CAST(sum({_h('spec_score * 1000000')}) AS BIGINT) AS sum_spec, max({_h('spec_score * 1000000')}) AS most_spec FROM scored GROUP BY product_id"),
    "similarity_score": _sql(f"SELECT product_id, CAST(sum({_h('similarity * 1000000')}) AS BIGINT) AS sum_similarity, max({_h('similarity * 1000000')}) AS most_similarity, CAST(sum({_h('price_score * 1000000')}) AS BIGINT) AS sum_price, CAST(sum({_h('market_score * 1000000')}) AS BIGINT) AS sum_market FROM scored GROUP BY product_id"),
    "data_quality": _sql(f"SELECT product_id, observations, in_stock_offers, {_h('quality * 1000000')} AS quality FROM quality"),
    "competitive_set": _sql("SELECT product_id, c AS c_product_id, final AS tier, place, weight_milli, c_price FROM member"),
    "reference_set": _sql("SELECT product_id, c AS c_product_id, n AS place, reason FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY similarity DESC, c) AS n FROM classified WHERE final = 'reference') WHERE n <= 6"),
    "coverage_level": _sql("SELECT * FROM coverage"),
    "set_diversity": _sql(f"SELECT product_id, brands, tiers, marketplaces, spread_tenths, concat_ws(',', CASE WHEN brands = 1 THEN 'one_brand' END, CASE WHEN marketplaces = 1 THEN 'one_marketplace' END, CASE WHEN spread_tenths < 80 AND n >= 3 THEN 'tight' END) AS notes FROM (SELECT product_id, count(DISTINCT c_brand) AS brands, count(DISTINCT c_tier) AS tiers, count(*) AS n, len(list_distinct(flatten(list(c_marketplaces)))) AS marketplaces, {_h('(max(c_price) - min(c_price)) * 1000 / min(c_price)')} AS spread_tenths FROM member GROUP BY product_id)"),
    "product_strength": _sql(f"""SELECT product_id, {_h('r * 1000')} AS rating_milli, {_h('v * 1000')} AS reviews_milli, {_h('s * 1000')} AS specs_milli, {_h('t * 1000')} AS tier_milli, {_h('(0.3::DOUBLE * r + 0.15::DOUBLE * v + 0.35::DOUBLE * s + 0.2::DOUBLE * t) * 1000')} AS index_milli FROM (
      SELECT product_id, coalesce(least(greatest((rating_tenths - m_rating) / 4::DOUBLE, -1), 1), 0) AS r, CASE WHEN review_count > 0 AND m_reviews > 0 THEN least(greatest(log10(review_count / m_reviews), -1), 1) ELSE 0::DOUBLE END AS v, CASE WHEN a + b > 0 THEN (a - b) / (a + b) ELSE 0::DOUBLE END AS s, least(greatest(tier - m_tier, -1), 1) AS t FROM (
        SELECT *, coalesce((size > m_size)::INT, 0) + coalesce((grade < m_grade)::INT, 0) AS a, coalesce((size < m_size)::INT, 0) + coalesce((grade > m_grade)::INT, 0) AS b FROM (
          SELECT product_id, any_value(rating_tenths) AS rating_tenths, any_value(review_count) AS review_count, any_value(tier) AS tier, any_value(size) AS size, any_value(grade) AS grade, quantile_cont(c_rating, 0.5) AS m_rating, quantile_cont(c_reviews, 0.5) AS m_reviews, quantile_cont(c_tier, 0.5) AS m_tier, quantile_cont(c_size, 0.5) AS m_size, quantile_cont(c_grade, 0.5) AS m_grade FROM member GROUP BY product_id)))"""),
    "evidence_score": _sql("SELECT * FROM evidence", True),
    "market_anchor": _sql("SELECT product_id, own_n, normal, anchor FROM anchors", True),
    "market_distortion": _sql("SELECT distortion, count(*) AS products FROM anchors GROUP BY distortion", True),
    "price_zones": _sql("SELECT * FROM zones", True),
    "price_bounds": _sql("SELECT product_id, ceiling, ceiling_source, market_floor, break_even_floor, floor, CASE WHEN break_even_floor >= market_floor THEN 'break_even' ELSE 'market' END AS floor_source, middle, conflict FROM bounds", True),
    "hedonic": _sql(f", {_FIT.strip()} SELECT * FROM fits"),
    "strategy_prices": _sql(f", {_STRATEGIES} SELECT product_id, fast, balanced, premium, {_BOUND.format('raw_fast')} AS fast_bound, {_BOUND.format('raw_balanced')} AS balanced_bound, {_BOUND.format('raw_premium')} AS premium_bound FROM strategies", True),
    "sanity_checks": _sql(f""", {_STRATEGIES} SELECT product_id, abs(fast - anchor) <= 0.35::DOUBLE * anchor AND abs(balanced - anchor) <= 0.35::DOUBLE * anchor AND abs(premium - anchor) <= 0.35::DOUBLE * anchor AS near_anchor,
      coalesce(greatest(fast, balanced, premium) <= mrp.applicable_mrp, true) AS under_mrp, least(fast, balanced, premium) >= floor AS over_floor, fast <= balanced AND balanced <= premium AS ordered, worth > 0 AS supported,
      greatest(fast, balanced, premium) <= {_h("1.02::DOUBLE * CASE WHEN worth > 0 THEN %s ELSE greatest(own_max, anchor) END" % _h("own_median * 1.25::DOUBLE"))} AS within_own_market, distortion = 'normal' AS undistorted, coalesce(middle >= break_even_floor, true) AS viable
      FROM strategies LEFT JOIN mrp USING (product_id)""", True),
    "recommendation": _sql(f""", {_STRATEGIES} SELECT product_id, universal_effective AS current_price, coalesce(direct + comparable, 0) AS members,
      CASE WHEN universal_effective IS NULL THEN 'no_current_price' WHEN coalesce(direct + comparable, 0) < 3 THEN 'too_few_comparables' WHEN coalesce(b.conflict, false) THEN 'no_valid_price' ELSE 'ok' END AS status, fast, balanced, premium, s.evidence, s.distortion,
      CASE WHEN fast IS NOT NULL THEN fast = balanced OR balanced = premium OR fast = premium END AS collapsed
      FROM product LEFT JOIN (SELECT product_id, universal_effective FROM price) USING (product_id) LEFT JOIN (SELECT product_id, direct, comparable FROM coverage) USING (product_id) LEFT JOIN (SELECT product_id, conflict FROM bounds) b USING (product_id) LEFT JOIN (SELECT product_id, fast, balanced, premium, evidence, distortion FROM strategies) s USING (product_id)""", True),
    "source_overview": _sql(f"""SELECT r_regionkey AS marketplace_id, r_name AS marketplace_name, last_run, attempted, succeeded, coalesce(runs, 0) AS runs, coalesce(listings, 0) AS listings, confidence_bp, coalesce(confirmed, 0) AS confirmed FROM region
      LEFT JOIN (SELECT marketplace_id, max(d) AS last_run, arg_max(a, d) AS attempted, arg_max(s, d) AS succeeded, count(*) AS runs FROM (SELECT CAST(user_id % 5 AS INT) AS marketplace_id, CAST(ts AS DATE) AS d, count(*) AS a, count_if(event_type <> 'error') AS s FROM events GROUP BY ALL) GROUP BY marketplace_id) run ON run.marketplace_id = r_regionkey
      LEFT JOIN (SELECT marketplace_id, count(*) AS listings, {_h('sum(confidence_pct) * 100 / count(*)')} AS confidence_bp, count_if(human_confirmed) AS confirmed FROM listing GROUP BY marketplace_id) l ON l.marketplace_id = r_regionkey"""),
    "recent_runs": _sql(f"SELECT *, {_h('pages_succeeded * 10000 / pages_attempted')} AS success_bp FROM (SELECT CAST(user_id % 5 AS INT) AS marketplace_id, CAST(ts AS DATE) AS run_date, count(*) AS pages_attempted, count_if(event_type <> 'error') AS pages_succeeded FROM events GROUP BY ALL) ORDER BY run_date DESC, marketplace_id"),
    "capture_ages": _sql("""SELECT CASE WHEN event_type = 'error' THEN 'rejection' ELSE 'document' END AS entity, event_id AS id, coalesce(strftime(ts, '%-d %b %Y'), '—') AS day, coalesce(strftime(ts, '%-d %b'), '—') AS short_day, coalesce(strftime(ts, '%-d %b %Y, %I:%M ') || lower(strftime(ts, '%p')), '—') AS moment,
      CASE WHEN m IS NULL THEN '—' WHEN m < 60 THEN m || 'm ago' WHEN h < 24 THEN h || 'h ago' ELSE CAST(floor(h / 24 + 0.5) AS BIGINT) || 'd ago' END AS age
      FROM (SELECT *, CAST(floor(m / 60 + 0.5) AS BIGINT) AS h FROM (SELECT *, CAST(floor((epoch_us(max(ts) OVER ()) - epoch_us(ts)) / 60000000 + 0.5) AS BIGINT) AS m FROM events WHERE event_type IS NOT NULL))"""),
    "recent_rejections": _sql("SELECT e.event_id AS rejection_id, e.event_id - 1 AS document_id, CASE WHEN e.event_id % 3 = 0 THEN 'listing' ELSE 'offer' END AS target_entity, e.ts AS captured_at, CAST(d.user_id % 5 AS INT) AS marketplace_id, d.event_type AS page_kind FROM events e LEFT JOIN events d ON d.event_id = e.event_id - 1 AND d.event_type <> 'error' WHERE e.event_type = 'error' ORDER BY captured_at DESC, rejection_id DESC"),
    "field_coverage": _sql(f"""SELECT marketplace_id, field, count(*) AS total, count(v) AS filled, {_h('count(v) * 10000 / count(*)')} AS coverage_bp FROM (
      SELECT marketplace_id, 'specifications' AS field, CAST(grade AS BIGINT) AS v FROM listing JOIN product USING (product_id) UNION ALL SELECT marketplace_id, 'rating', CASE WHEN listing_id IN (SELECT listing_id FROM review) THEN 1 END FROM listing
      UNION ALL SELECT marketplace_id, 'selling_price', selling FROM observation UNION ALL SELECT marketplace_id, 'mrp', mrp FROM observation UNION ALL SELECT marketplace_id, 'sale_label', disc FROM observation WHERE sale_label IS NOT NULL UNION ALL SELECT marketplace_id, 'sale_label', NULL FROM observation WHERE sale_label IS NULL) GROUP BY ALL"""),
    "match_quality": _sql("SELECT product_id, min(confidence_pct) IS NOT NULL AS known, min(confidence_pct) AS min_confidence, count_if(NOT human_confirmed) AS auto_matched, count(listing_id) AS listings FROM product LEFT JOIN listing USING (product_id) GROUP BY product_id"),
    "spec_tally": _sql(f"""SELECT *, {_h('(match + partial + differ) * 10000 / (4 * candidates)')} AS compared_bp FROM (
      SELECT product_id, count(*) AS candidates, CAST(sum((s_size >= 0.98::DOUBLE)::INT + coalesce((s_grade >= 0.98::DOUBLE)::INT, 0) + s_material + s_large) AS BIGINT) AS match, CAST(sum((s_size > 0.15::DOUBLE AND s_size < 0.98::DOUBLE)::INT + coalesce((s_grade > 0.15::DOUBLE AND s_grade < 0.98::DOUBLE)::INT, 0)) AS BIGINT) AS partial,
        CAST(sum((s_size <= 0.15::DOUBLE)::INT + coalesce((s_grade <= 0.15::DOUBLE)::INT, 0) + 2 - s_material - s_large) AS BIGINT) AS differ, count_if(s_grade IS NULL) AS missing FROM compared GROUP BY product_id)"""),
    "coverage_explained": _sql(", " + _EXPLAINED + " SELECT product_id, level, meets_target, sufficient, screened_out, shortfall FROM explained"),
    "refusals": _sql(", " + _EXPLAINED + """ SELECT product_id, CASE WHEN universal_effective IS NULL THEN 'no_current_price' ELSE 'too_few_comparables' END AS reason,
      concat_ws(' | ', shortfall, 'capture more of this type on its marketplaces', CASE WHEN screened_out > 0 THEN 'review screened out: ' || screened_out END, CASE WHEN cost IS NULL THEN 'enter a seller cost' END) AS what_would_help
      FROM explained LEFT JOIN (SELECT product_id, universal_effective FROM price) USING (product_id) LEFT JOIN seller_cost USING (product_id) WHERE universal_effective IS NULL OR NOT sufficient"""),
    "address_request": _browse("SELECT place, product_id, min_price FROM (" + _RESULTS % "min_price ASC NULLS LAST" + ")", **_ADDRESS),
    "price_labels": _sql(f"""SELECT product_id, '₹' || CASE WHEN len(q) <= 3 THEN q ELSE ltrim(reverse(regexp_replace(reverse(q[:-4]), '(..)', '\\1,', 'g')), ',') || ',' || q[-3:] END AS price,
      CASE WHEN bp < 0 THEN '-' WHEN bp > 0 THEN '+' ELSE '' END || (t // 10) || '.' || (t % 10) || '%' AS trend
      FROM (SELECT *, {_h('abs(bp) / 10')} AS t FROM (SELECT product_id, CAST({_h('current_price / 100')} AS VARCHAR) AS q, {_h('(current_price - first_price) * 10000 / first_price')} AS bp FROM history))"""),
}
# A body that starts with a comma goes on with the common table expressions.
ORACLE_SQL = {k: v.replace("\n, ", ",\n", 1) if "\n, " in v else v for k, v in ORACLE_SQL.items()}
