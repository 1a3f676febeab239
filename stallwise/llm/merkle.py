"""Merkle manifest of a dataset: a digest of every row, of every tree of rows and of all trees, with a proof for each row.

Rows get their place in their tree from a range sort and counts by partition. A superblock is fanout^levels nodes in
a row; one task collapses it by that many levels at once, and the roots of superblocks are nodes of the next
reduction, until one is left. Proofs come down the same way: a superblock's own proof, made once above, is put
behind what each of its nodes finds inside it. No task ever holds more than one superblock.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

FANOUT = 2
#: Levels that one task collapses: superblocks of 4,096 nodes.
LEVELS = 12
#: Fields of a row's digest, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "before array<string>, after array<string>"


def digest(data: str) -> str:
    return hashlib.sha256(data.encode("ascii")).hexdigest()


def leaf(**values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and itself, a null as a dash."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(field(values[k]) for k in FIELDS)), 256)


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes: (tree, digest, ...), trees never null -> the same with ``idx``, its place in its tree by ``order`` and digest, and ``size`` of the tree.

    A range sort deals rows evenly whatever the sizes of trees. A row's place is where it stands in its partition plus
    what earlier partitions hold of its tree; that table has at most a row for each partition and one for each tree.
    """
    keys = [F.asc_nulls_first(c) for c in ("tree", *order, "digest")]
    dealt = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(dealt).withColumn("_part", F.shiftrightunsigned("_at", 33))
    runs = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    upto = W.partitionBy("tree").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_skip"), F.sum("_n").over(W.partitionBy("tree")).alias("size"))
    return dealt.join(runs, ["tree", "_part"]).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_skip")).drop("_at", "_part", "_first", "_skip")


def _collapsed(size: int, fanout: int, levels: int) -> int:
    """Levels by which a superblock of a tree of ``size`` nodes is collapsed: ``levels``, or to the root if that comes first."""
    k, left = 0, size
    while left > 1 and k < levels:
        left = -(-left // fanout)
        k += 1
    return k


def collapse(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """Digests of every level over a run of nodes, the nodes themselves first; a short run at the end is hashed as well."""
    out = [digests]
    for _ in range(levels):
        now = out[-1]
        out.append([digest("".join(now[i : i + fanout])) for i in range(0, len(now), fanout)])
    return out


def _roots(fanout: int, levels: int):
    def root(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        size, first = table["size"][0].as_py(), table["idx"][0].as_py()
        k = _collapsed(size, fanout, levels)
        top = collapse(table["digest"].to_pylist(), k, fanout)[-1][0]
        return pa.table({"tree": table["tree"].slice(0, 1), "size": pa.array([-(-size // fanout**k)], pa.int64()), "idx": pa.array([first // fanout**levels], pa.int64()), "digest": pa.array([top])})

    return root


def _proofs(fanout: int, levels: int, payload: list[str]):
    def below(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("idx")
        n = nodes.num_rows
        if not n:
            return nodes.select(["tree", "idx", "digest", *payload]).append_column("root", pa.array([], pa.string())).append_column("before", pa.array([], pa.list_(pa.string()))).append_column("after", pa.array([], pa.list_(pa.string())))
        k = _collapsed(nodes["size"][0].as_py(), fanout, levels)
        parts = {"before": [], "after": []}
        places, held = [], 0
        for level, now in enumerate(collapse(nodes["digest"].to_pylist(), k, fanout)[:-1] if k else []):
            for i in range(len(now)):
                run = i - i % fanout
                parts["before"].append("".join(now[run:i]))
                parts["after"].append("".join(now[i + 1 : run + fanout]))
            places.append(held + np.arange(n) // fanout**level)
            held += len(now)
        upper = len(above["before"][0])
        places += [np.full(n, held + j) for j in range(upper)]
        flat = np.stack(places, 1).ravel() if places else np.empty(0, np.int64)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (k + upper))
        out = nodes.select(["tree", "idx", "digest", *payload]).append_column("root", pa.array([above["root"][0].as_py()] * n, pa.string()))
        for side, own in parts.items():
            values = pa.array(own + above[side][0].as_py(), pa.string()).take(pa.array(flat))
            out = out.append_column(side, pa.ListArray.from_arrays(offsets, values))
        return out

    return below


def reduce_trees(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """nodes: (tree, size, idx, digest) -> one frame for each reduction, the nodes first, the trees' roots (idx 0) last."""
    block = fanout**levels
    out = [nodes]
    left = nodes.agg(F.max("size")).first()[0] or 1
    while left > 1:
        grouped = out[-1].select("tree", "size", "idx", "digest").groupBy("tree", F.floor(F.col("idx") / block).alias("block"))
        out.append(cut(grouped.applyInArrow(_roots(fanout, levels), "tree string, size long, idx long, digest string")))
        left = -(-left // block)
    return out


def prove(reductions: list[DataFrame], above: DataFrame, payload: list[str] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Proofs of the nodes of the first reduction; ``above``: (tree, root, before, after), the proof of each tree's own root.

    Returns (tree, idx, digest, payload..., root, before, after): for each level, the siblings' digests in front of the node and behind it.
    """
    payload = payload or []
    now = above.withColumn("idx", F.lit(0).cast("long"))
    for depth in range(len(reductions) - 2, -1, -1):
        nodes = reductions[depth]
        extra = payload if depth == 0 else []
        types = "".join(f", {c} {nodes.schema[c].dataType.simpleString()}" for c in extra)
        left = nodes.select("tree", "size", "idx", "digest", *extra).groupBy("tree", F.floor(F.col("idx") / fanout**levels).alias("block"))
        right = now.select("tree", "idx", "root", "before", "after").groupBy("tree", F.col("idx").alias("block"))
        now = left.cogroup(right).applyInArrow(_proofs(fanout, levels, extra), f"tree string, idx long, digest string{types}, root string, {_PROOF}")
    if len(reductions) == 1:
        now = reductions[0].select("tree", "idx", "digest", *payload).join(above, "tree")
    return now


def manifest(leaves: DataFrame, order: list[str], payload: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaves: (tree, digest, ``order`` and ``payload`` columns); trees are never null and are ordered bytewise.

    Returns (tree, digest, payload..., subroot, root, before, after). A tree of one leaf is its own subroot. Ties of
    ``order`` are ordered by digest, repeated leaves each keep their place. No leaves give no rows.
    """
    trees = reduce_trees(placed(leaves, order), fanout, levels)
    tops = trees[-1].select(F.col("tree").alias("name"), F.col("digest"))
    crown = reduce_trees(placed(tops.select(F.lit("").alias("tree"), "name", "digest"), ["name"]), fanout, levels)
    none = F.array().cast("array<string>")
    root = crown[-1].select("tree", F.col("digest").alias("root"), none.alias("before"), none.alias("after"))
    above = cut(prove(crown, root, ["name"], fanout, levels).select(F.col("name").alias("tree"), F.struct("digest", "root").alias("roots"), "before", "after"))
    # Both roots travel as one text on the way down.
    down = prove(trees, above.select("tree", F.concat_ws(":", "roots.digest", "roots.root").alias("root"), "before", "after"), payload, fanout, levels)
    roots = F.split("root", ":")
    return down.select("tree", "digest", *payload, roots[0].alias("subroot"), roots[1].alias("root"), "before", "after")


def fold(start: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a"))), start, lambda acc, s: F.sha2(F.concat(s["b"], acc, s["a"]), 256))


def dataset_manifest(docs: DataFrame, claims: dict[str, Column] | None = None) -> DataFrame:
    """Manifest of a documents table with a tree for each lang, leaves by doc_id.

    ``claims`` replaces fields of rows by what somebody else says they are; ``claimed`` is the digest of that. A null
    lang is the first tree, a null doc_id comes first in its tree, rows of one id are ordered by digest, null and
    empty texts differ. An empty table gives no rows. Columns besides the five fields are ignored.
    """
    own = {c: F.col(c) for c in FIELDS}
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    # Texts are read once; only digests are sorted.
    leaves = cut(docs.select("doc_id", tree.alias("tree"), leaf(**own).alias("digest"), leaf(**(own | (claims or {}))).alias("claimed")))
    return manifest(leaves, ["doc_id"], ["doc_id", "claimed"]).withColumnRenamed("digest", "leaf").drop("tree")
