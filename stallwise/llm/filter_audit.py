"""Interaction audit of quality filters: what each removes in every order in which they could be applied.

A document is only its mask of failed filters, so each part of the corpus is three rows (all documents, good ones,
toxic ones) of counts by mask. Stacked, those rows are multiplied by integer matrices with a row for each mask
and a column for each (order, step); the products are all the numbers asked for. Nothing is filtered 120 times.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The filters whose failure depends on a text alone, in the order of their bits; the copy filter E follows them.
TEXT_FILTERS = "ABCD"
COPY_FILTER = "E"
FILTERS = TEXT_FILTERS + COPY_FILTER
WHITE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = "[#$%&*|]"
#: What a document is counted as: each is a row of the stacked histogram.
LAYERS = ("docs", "good", "toxic")
AUDIT_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """Bits of the text filters that a text fails; a null text is an empty one."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, WHITE), lambda w: w != "")
    n = F.size(words)
    fails = (
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * (F.length(t) - F.length(F.translate(t, UPPER, ""))) > 2 * F.length(t),
        t.rlike(SIGNS),
    )
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def incidence(filters: str) -> dict[str, np.ndarray]:
    """Matrices of 2^n masks by n! * n (order, step) columns: whether a document of that mask is kept after the step,
    removed in it, redundant in it, or fails its filter alone; and shapley, how many of the orders remove it by the step's filter."""
    n = len(filters)
    orders = list(permutations(range(n)))
    mask = np.arange(1 << n)[:, None]
    bit = np.array([[1 << f for f in order] for order in orders]).ravel()
    before = np.array([[sum(1 << f for f in order[:s]) for s in range(n)] for order in orders]).ravel()
    fails, gone = (mask & bit) != 0, (mask & before) != 0
    removed = (fails & ~gone).astype(np.int64)
    by_filter = {b: removed[:, bit == b].sum(1) for b in set(bit.tolist())}
    return {
        "kept": (~fails & ~gone).astype(np.int64), "removed": removed, "redundant": (fails & gone).astype(np.int64), "unique_fails": np.broadcast_to(mask == bit, fails.shape).astype(np.int64),
        "shapley": np.stack([by_filter[b] for b in bit.tolist()], 1),
    }


def multiply(histogram: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, docs, good, toxic), each of the three an array of counts by mask -> a row for each part, order and step.

    Parts are multiplied a batch at a time by the same matrices, so a task holds one batch of products.
    """

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = incidence(filters)
        n = len(filters)
        names = ["".join(o) for o in permutations(filters) for _ in range(n)]
        steps = np.tile(np.arange(1, n + 1, dtype=np.int32), len(names) // n)
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                rows = pdf.iloc[at : at + 64]
                docs, good, toxic = (np.array(rows[c].tolist(), np.int64).reshape(len(rows), -1) for c in LAYERS)
                out = {"part": np.repeat(rows["part"].to_numpy(), len(names)), "filter_order": np.tile(names, len(rows)), "step": np.tile(steps, len(rows))}
                out |= {c: (docs @ m[c]).ravel() for c in ("kept", "removed", "redundant", "unique_fails")}
                out |= {"good_lost": (good @ m["removed"]).ravel(), "toxic_lost": (toxic @ m["removed"]).ravel(), "shapley": (docs @ m["shapley"]).ravel()}
                yield pd.DataFrame(out)

    return histogram.mapInPandas(products, AUDIT_SCHEMA)


def histogram(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, mask, docs, good, toxic) -> one row per part with an array of counts by mask for each layer."""
    at = lambda c, k: F.coalesce(F.sum(F.when(F.col("mask") == k, F.col(c))), F.lit(0)).cast("long")
    return counts.groupBy("part").agg(*(F.array(*(at(c, k) for k in range(1 << len(filters)))).alias(c) for c in LAYERS))


def masked_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by part and mask of all five filters.

    Texts go no further than the scan: a document is its mask, the digest of its text, its part and its id. Copies
    of a text are folded into a count for each part and label before their least id is sought, so a
    text that a third of all documents share costs no task more than any other.
    """
    marked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    # Read and judged once; what follows works on these few bytes a document.
    marked = cut(marked)
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    labelled = marked.where("doc_id IS NOT NULL").join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quality", "toxic")})
    # A document without an id has no label, and no other id is smaller than it: it neither fails E nor makes others fail.
    without = marked.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("docs"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))

    kind = ("digest", "mask", "part", "quality", "toxic")
    one = labelled.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    folded = one.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    least = folded.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    whole = folded.join(least, "digest")
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    e = 1 << FILTERS.index(COPY_FILTER)
    split = F.inline(F.array(F.struct(F.col("mask").alias("mask"), firsts.alias("docs")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - firsts).alias("docs"))))
    rows = whole.select("part", "quality", "toxic", split)
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("docs"))), F.lit(0))
    counted = rows.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), of("quality").alias("good"), of("toxic").alias("toxic"))
    return counted.unionByName(without)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (source), order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null source is the part of the empty string, a null text an empty text. A document without an id counts, but is
    no copy and has no label. Rows of one id and text are all the first of their copies. Of repeated
    labels any 1 counts. No documents give no rows. Other columns of either table are ignored.
    """
    return multiply(histogram(masked_counts(docs, labels)))
