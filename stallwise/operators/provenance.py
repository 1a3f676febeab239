"""Where the data came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import age_label, day_label, half_up, moment_label
from ..sources.roles import Roles


def source_overview(r: Roles) -> DataFrame:
    """Per marketplace: its latest capture run, listings, mean match confidence and confirmed matches."""
    last = r.capture_run.groupBy("marketplace_id").agg(F.max(F.struct("run_date", "pages_attempted", "pages_succeeded")).alias("run"), F.count("*").alias("runs"))
    listed = r.listing.groupBy("marketplace_id").agg(F.count("*").alias("listings"), F.sum("confidence_pct").alias("c"), F.count_if("human_confirmed").alias("confirmed"))
    out = r.marketplace.join(F.broadcast(last), "marketplace_id", "left").join(F.broadcast(listed), "marketplace_id", "left")
    return out.select("marketplace_id", "marketplace_name", F.col("run.run_date").alias("last_run"), F.col("run.pages_attempted").alias("attempted"), F.col("run.pages_succeeded").alias("succeeded"), F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("listings", F.lit(0)).alias("listings"), half_up(F.col("c") * 100 / F.col("listings")).alias("confidence_bp"), F.coalesce("confirmed", F.lit(0)).alias("confirmed"))


def recent_runs(r: Roles) -> DataFrame:
    """Capture runs, the latest first, with the share of pages that succeeded in basis points."""
    return r.capture_run.withColumn("success_bp", half_up(F.col("pages_succeeded") * 10000 / F.col("pages_attempted"))).orderBy(F.desc("run_date"), "marketplace_id")


def capture_ages(r: Roles) -> DataFrame:
    """Every kept document and rejected record: when it was captured, as a day, as a moment and as an age at the latest capture of all."""
    at = lambda df, what, key, when: df.select(F.lit(what).alias("entity"), F.col(key).alias("id"), F.col(when).alias("at"))
    rows = at(r.raw_document, "document", "document_id", "fetched_at").unionByName(at(r.rejected_record, "rejection", "rejection_id", "captured_at"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("at").alias("now"))))  # one row
    return rows.select("entity", "id", day_label(F.col("at")).alias("day"), day_label(F.col("at"), year=False).alias("short_day"), moment_label(F.col("at")).alias("moment"), age_label(F.col("at"), F.col("now")).alias("age"))


def recent_rejections(r: Roles) -> DataFrame:
    """Rejected records, the latest first, with the document that they came from where it was kept."""
    rows = r.rejected_record.join(r.raw_document, "document_id", "left")
    return rows.select("rejection_id", "document_id", "target_entity", "captured_at", "marketplace_id", "page_kind").orderBy(F.desc("captured_at"), F.desc("rejection_id"))


def field_coverage(r: Roles) -> DataFrame:
    """Per marketplace and field: rows, and those that hold a value, in number and basis points."""
    has_grade = r.spec.where("attribute_key = 'grade'").select("product_id", F.lit(1).alias("graded"))
    rated = r.review.select("listing_id").distinct().withColumn("rated", F.lit(1))
    listed = r.listing.join(has_grade, "product_id", "left").join(rated, "listing_id", "left").groupBy("marketplace_id").agg(F.count("*").alias("n"), F.count("graded").alias("specifications"), F.count("rated").alias("rating"))
    priced = r.observation.groupBy("marketplace_id").agg(F.count("*").alias("n"), F.count("selling").alias("selling_price"), F.count("mrp").alias("mrp"), F.count("sale_label").alias("sale_label"))
    long = lambda wide, fields: wide.unpivot(["marketplace_id", "n"], fields, "field", "filled")
    rows = long(listed, ["specifications", "rating"]).union(long(priced, ["selling_price", "mrp", "sale_label"]))
    return rows.select("marketplace_id", "field", F.col("n").alias("total"), "filled", half_up(F.col("filled") * 10000 / F.col("n")).alias("coverage_bp"))


def match_quality(r: Roles) -> DataFrame:
    """Per product: whether its listings' match confidence is known, the least of it, and how many no human confirmed."""
    got = r.listing.groupBy("product_id").agg(F.count("*").alias("total"), F.min("confidence_pct").alias("least"), F.count_if(~F.col("human_confirmed")).alias("auto"))
    return r.product.select("product_id").join(got, "product_id", "left").select("product_id", F.col("least").isNotNull().alias("known"), F.col("least").alias("min_confidence"), F.coalesce("auto", F.lit(0)).alias("auto_matched"), F.coalesce("total", F.lit(0)).alias("listings"))
