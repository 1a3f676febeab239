"""Trees of any depth: paths, departments and subtrees by pointer jumping.

Every node holds the names from a cursor down to itself; in each round the cursor's own names are put in front, so
that covered depth doubles. A tree of depth d takes about log2(d) joins on the node table, whatever its shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Stages


def rooted(tree: DataFrame, stages: Stages | None = None) -> DataFrame:
    """tree: (id, parent_id, level, name) -> (id, level, name, ids, names, cyclic): ancestors from the root to the node itself.

    A parent that isn't in the tree ends the path. A node on or under a cycle has null ids and names and is
    marked cyclic: it has no root.
    """
    stages = stages or Stages(tree.sparkSession)
    now = tree.select("id", "level", "name", F.array("id").alias("ids"), F.array("name").alias("names"), F.col("parent_id").alias("cursor"), F.lit(False).alias("cyclic"))
    now, k = stages.put("tree0", now), 0
    while now.where("cursor IS NOT NULL").limit(1).count():
        above = now.select(F.col("id").alias("a_id"), F.col("ids").alias("a_ids"), F.col("names").alias("a_names"), F.col("cursor").alias("a_cursor"), F.col("cyclic").alias("a_cyclic"))
        joined = now.join(above, F.col("cursor") == F.col("a_id"), "left")
        none = F.lit(None)
        # A cursor that comes back to what is already on the path runs in a circle.
        circle = F.col("cyclic") | F.coalesce(F.col("a_cyclic") | F.arrays_overlap("ids", "a_ids"), F.lit(False))
        longer = lambda mine, theirs: F.when(~circle, F.when(F.col("a_id").isNull(), F.col(mine)).otherwise(F.concat(theirs, mine)))
        jumped = joined.select("id", "level", "name", longer("ids", "a_ids").alias("ids"), longer("names", "a_names").alias("names"), F.when(circle, none).otherwise(F.col("a_cursor")).alias("cursor"), circle.alias("cyclic"))
        k += 1
        now = stages.put(f"tree{k}", jumped)
        stages.drop(f"tree{k - 1}")
    return now.drop("cursor")


def paths(nodes: DataFrame) -> DataFrame:
    """Every rooted node with its names from the root."""
    return nodes.where("NOT cyclic").select("id", "level", F.concat_ws("/", "names").alias("path"))


def departments(nodes: DataFrame) -> DataFrame:
    """Every node with the root that it sits under (null on a cycle) and its depth, roots having 1."""
    return nodes.select("id", F.col("ids")[0].alias("department"), F.col("names")[0].alias("department_name"), F.size("ids").alias("depth"), "cyclic")


def subtrees(nodes: DataFrame) -> DataFrame:
    """(ancestor, id) of every rooted node and everything under it, itself included."""
    return nodes.where("NOT cyclic").select(F.explode("ids").alias("ancestor"), "id")
