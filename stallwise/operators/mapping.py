"""Where each node of our tree sits in each marketplace's own tree: curated rows first, the rest inferred by profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.roles import Roles
from .trees import rooted


def inferred_mappings(nodes: DataFrame, profiles: DataFrame, curated: DataFrame) -> DataFrame:
    """A row for each marketplace with a profile and each leaf of a department that it sells in, unless a curated row has the pair.

    nodes: (id, ids, names) with paths from the root, the leaves to map; profiles: (marketplace_id, prefix, confidence_pct,
    mapped_by, departments), a null array of departments being all; curated: (marketplace_id, node_id, ...).
    """
    sells = profiles.where("departments IS NOT NULL").withColumn("department", F.explode("departments"))
    everywhere = nodes.select(F.col("ids")[0].alias("department")).distinct()
    # Profiles are a handful of rows; those that sell everything get a row for each department, so that leaves meet them by an equi-join.
    general = profiles.where("departments IS NULL").join(everywhere, F.lit(True))
    reach = sells.unionByName(general.select(*sells.columns))
    leaves = nodes.select(F.col("id").alias("node_id"), F.col("ids")[0].alias("department"), "names")
    pairs = leaves.join(F.broadcast(reach), "department").join(curated.select("marketplace_id", "node_id"), ["marketplace_id", "node_id"], "left_anti")
    last = F.array_join(F.transform(F.slice("names", F.greatest(F.size("names") - 1, F.lit(1)), 2), lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]+", "-"))), "-")
    words = F.array_join(F.transform("names", lambda x: F.initcap(F.regexp_replace(x, "[-#]+", " "))), " > ")
    return pairs.select("marketplace_id", "node_id", F.concat_ws("-", "prefix", last).alias("external_node_id"), words.alias("raw_path"), "confidence_pct", "mapped_by")


def taxonomy_mapping(r: Roles) -> DataFrame:
    """Curated rows and inferred ones of every leaf that products are sold under."""
    sold = r.offer.select(F.concat(F.lit("s"), F.col("seller_id")).alias("id")).distinct()
    leaves = rooted(r.tree).where("NOT cyclic").join(sold, "id", "left_semi")
    inferred = inferred_mappings(leaves, r.mapping_profile, r.curated_mapping)
    return r.curated_mapping.unionByName(inferred)
