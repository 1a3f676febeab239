"""A few queries of each family against their SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = ["current_effective_price", "price_ladder_rows", "history_stats", "sale_windows", "merged_price_grid", "tracked_summary", "marketplace_comparison", "facet_specs", "catalogue_sorted", "category_subtree", "departments", "catalogue_facets", "catalogue_typed", "catalogue_envelope", "product_pages", "listing_pages", "price_histories", "taxonomy_mapping", "rationales", "psych_snap", "weighted_distribution", "competitive_set", "price_bounds", "hedonic", "sanity_checks", "recommendation", "source_overview", "recent_rejections", "capture_ages", "field_coverage", "match_quality", "spec_tally", "coverage_explained", "refusals", "address_request", "price_labels", "compact_prices"]


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return str(v)[:10]
    return str(v) if isinstance(v, datetime.date) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, DIR)
    assert sorted(columns) == sorted(got.columns)
    assert rows(columns, want.fetchall()) == rows(got.columns, [tuple(r) for r in got.collect()])
