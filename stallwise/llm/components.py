"""Connected components of an undirected graph, by alternating large and small stars.

Each round is a grouped minimum and a join; no adjacency list is ever gathered, so a vertex
with a third of all rows as neighbours costs only partial aggregates and a splittable join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v). Links u's larger (or smaller) neighbours, and in the small star u itself, to the least of its neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: two columns of ids -> (id, component), component the least id reachable; ids without an edge are absent.

    Null ids and loops are ignored; no edges give no rows. Raises if it hasn't settled after ``most_rounds``.
    """
    a, b = edges.columns
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        now = cut(_star(_star(now, True), False))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
