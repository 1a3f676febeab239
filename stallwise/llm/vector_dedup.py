"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets a key, the concatenated signs of its products with random
directions, and all vectors are ordered by that key; a window of neighbours in that order is
compared in double precision and pairs at or over the threshold are joined. Passes with other
directions give near vectors further chances to meet. All passes run as one range-partitioned
sort of (pass, key); both sides of a partition's border are compared by a second, small step.

Where rows crowd, near vectors must agree in more bits to come within a window. The first PROBES passes
measure this: how many bits a row shares with the rows a window away. Rows that would need more passes than
all rows get, unless their whole window is linked already, go on among themselves: with windows of
WIDE_WINDOW, measured again, and each with as many passes as it needs, or, where that is cheaper, compared
with all of them. There is no bound on the passes of a row.

Equal vectors collapse first, so copies cost nothing. Each task sends only a spanning forest of
the pairs that it verified. A window is bounded, so the direct links are counted exactly afterwards,
inside each component, between blocks of bounded size: counts leave a block, pairs never do.

A vector that is null, zero, or holds null or non-finite components links with nothing; vectors of
different lengths don't link. Rows without a vec_id are left out. Rows of one vec_id count as
different vectors. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

#: Neighbours on each side that a vector is compared with in a pass.
WINDOW = 256
#: Chance that two vectors at the threshold itself meet in some pass; it sets the number of passes.
RECALL = 0.97
#: Passes that measure crowding; passes of all rows at most; and the window of the rows that need more.
PROBES, COMMON_PASSES, WIDE_WINDOW = 4, 48, 1024
#: Rows of a block in which direct links are counted.
BLOCK = 512
_BITS = 62


def passes_for(n: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which two of ``n`` vectors at ``threshold`` have met with chance ``recall``: they must agree in the bits that narrow n down to a window."""
    agree = (1 - math.acos(threshold) / math.pi) ** max(1.0, math.log2(max(2, n) / window))
    return max(PROBES, math.ceil(math.log(1 - recall) / math.log(1 - min(agree, 0.95))))


def _matrix(column) -> np.ndarray:
    """Unit rows of a batch whose vectors all have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(seed: int):
    """(id, vector, since, until) -> a row for each of the passes since..until - 1 with the pass's key."""

    def of(batches):
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            since, until = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            size = np.diff(np.asarray(vectors.offsets)) if len(vectors) else np.zeros(0, int)
            for d in np.unique(size):
                mine = np.flatnonzero(size == d)
                unit = _matrix(vectors.take(pa.array(mine)))
                for k in range(since[mine].min(), until[mine].max()):
                    now = (since[mine] <= k) & (k < until[mine])
                    pick = pa.array(mine[now])
                    some_ids, some, x = ids.take(pick), vectors.take(pick), unit[now]
                    directions = np.random.default_rng((seed, k, int(d))).standard_normal((d, _BITS))
                    key = ((x @ directions > 0) << np.arange(_BITS - 1, -1, -1, dtype=np.int64)).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k * 65536 + d, np.int64)), pa.array(key), some_ids, some], ["pass", "key", "id", "vector"])

    return of


def _labels(i, j, n):
    """The least row that each of ``n`` rows is linked with by the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _forest(x, threshold, window, old=0):
    """Verified pairs among sorted unit rows, as each row's label; (label, row) are the edges of a spanning forest. Pairs within the first ``old`` rows are left out."""
    n = len(x)
    found_i, found_j = [np.zeros(0, int)], [np.zeros(0, int)]
    if window <= 64:
        for d in range(1, min(window, n - 1) + 1):
            start = max(0, old - d)
            hit = np.flatnonzero(np.einsum("ij,ij->i", x[start : n - d], x[start + d :]) >= threshold) + start
            found_i.append(hit)
            found_j.append(hit + d)
    else:
        for a in range(0, n, window):
            i, j = np.nonzero(x[a : a + window] @ x[a : a + 2 * window].T >= threshold)
            keep = (j > i) & (j - i <= window) & (a + j >= old)
            found_i.append(a + i[keep])
            found_j.append(a + j[keep])
    return _labels(np.concatenate(found_i), np.concatenate(found_j), n)


def _linked(label, ids):
    child = np.flatnonzero(label != np.arange(len(label)))
    return ids[label[child]], ids[child]


def _crowding(key, label, window, old):
    """For rows from ``old`` on, the bits that narrow the rows down to a window around each; 0 where a window is one component."""
    n = len(key)
    shared = np.zeros(n, np.int64)
    if n > window:
        # The highest bit that differs, by the exponent of the exact half; keys have 62 bits.
        differ = key[window:] ^ key[:-window]
        high, low = np.frexp((differ >> 31).astype(float))[1], np.frexp((differ & 0x7FFFFFFF).astype(float))[1]
        bits = _BITS - np.where(high > 0, high + 31, low)
        shared[window:] = bits
        shared[:-window] = np.maximum(shared[:-window], bits)
        shared += 1
    change = np.concatenate(([0], np.cumsum(label[old + 1 :] != label[old:-1]))) if n > old else np.zeros(0, int)
    at = np.arange(n - old)
    one = change[np.minimum(at + window, n - old - 1)] == change[np.maximum(at - window, 0)]
    return np.where(one, 0, np.minimum(shared[old:], _BITS))


def _windows(threshold: float, window: int):
    """A sorted partition -> edges, its first and last rows for the partitions beside it, and of the first passes (id, crowding in the place of the pass)."""

    def rim(part, k, ids, vectors, pick, side):
        n = len(pick)
        gone = pa.nulls(n, pa.int64())
        pick = pa.array(pick)
        return pa.RecordBatch.from_arrays([gone, gone, pa.array(np.full(n, part, np.int64)), pa.array(np.full(n, k, np.int64)), pa.array(np.full(n, side, np.int64)), ids.take(pick), vectors.take(pick)], ["a", "b", "border", "pass", "side", "id", "vector"])

    def of(batches):
        held = None  # the last rows of a pass so far: (pass, ids, vectors, keys)
        started = set()
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            passes = np.asarray(batch.column(1))
            for k in np.unique(passes):
                pick = np.flatnonzero(passes == k)
                ids, vectors = batch.column(2).take(pa.array(pick)), batch.column(3).take(pa.array(pick))
                keys = np.asarray(batch.column(4))[pick]
                old = 0
                if held and held[0] == k:
                    old = len(held[1])
                    ids, vectors = pa.concat_arrays([held[1], ids]), pa.concat_arrays([held[2], vectors])
                    keys = np.concatenate((held[3], keys))
                elif held:
                    held = None  # the pass before ends inside this partition
                if k not in started:
                    started.add(k)
                    if len(started) == 1:
                        yield rim(part - 1, k, ids, vectors, np.arange(min(window, len(ids))), 1)
                label = _forest(_matrix(vectors), threshold, window, old)
                a, b = _linked(label, np.asarray(ids))
                n = len(a)
                gone = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), gone, gone, gone, gone, pa.nulls(n, vectors.type)], ["a", "b", "border", "pass", "side", "id", "vector"])
                if k >> 16 < PROBES:
                    gone = pa.nulls(len(ids) - old, pa.int64())
                    yield pa.RecordBatch.from_arrays([gone, gone, gone, pa.array(_crowding(keys, label, window, old)), gone, ids[old:], pa.nulls(len(gone), vectors.type)], ["a", "b", "border", "pass", "side", "id", "vector"])
                keep = np.arange(max(0, len(ids) - window), len(ids))
                held = (k, ids.take(pa.array(keep)), vectors.take(pa.array(keep)), keys[keep])
        if held:
            yield rim(part, held[0], held[1], held[2], np.arange(len(held[1])), 0)

    return of


def _borders(threshold: float, window: int):
    """Rows (border, pass, side, id, vector), sorted -> edges across each border."""

    def of(table):
        side = np.asarray(table["side"])
        old = int((side == 0).sum())
        order = np.argsort(side, kind="stable")
        table = table.take(pa.array(order))
        if not old or old == len(side):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = _linked(_forest(_matrix(table["vector"]), threshold, window, old), np.asarray(table["id"]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return of


def _counts(threshold: float):
    """Rows (component, i, j, side, id, copies, vector) sorted by (component, i, j, side) -> (id, n): copies linked directly across blocks i and j."""

    def flush(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        side, ids, copies = (np.asarray(t[c]) for c in ("side", "id", "copies"))
        x = _matrix(t["vector"])
        near = x[side == 0] @ x[side == 1].T >= threshold
        p, q = ids[side == 0], ids[side == 1]
        near &= p[:, None] != q[None, :]
        out = [(p, near @ copies[side == 1])]
        if t["i"][0].as_py() != t["j"][0].as_py():
            out.append((q, copies[side == 0] @ near))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a for a, _ in out])), pa.array(np.concatenate([b for _, b in out]).astype(np.int64))], ["id", "n"])

    def of(batches):
        held, mine = [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(c)) for c in range(3)], 1)
            edges = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)])) if len(key) else []
            for a, b in zip(edges, edges[1:]):
                if mine != tuple(key[a]) and held:
                    yield flush(held)
                    held = []
                mine = tuple(key[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield flush(held)

    return of


def _across(threshold: float):
    """Rows (i, j, length, side, id, vector) of two blocks -> edges between them."""

    def of(table):
        side, ids = np.asarray(table["side"]), np.asarray(table["id"])
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x = _matrix(table["vector"])
        i, j = np.nonzero(x[p] @ x[q].T >= threshold)
        a, b = _linked(_labels(p[i], q[j], len(ids)), ids)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return of


def _passes(rows: DataFrame, threshold: float, window: int, parts: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """rows (id, vector, since, until) -> edges (a, b), and of the first passes (id, bits)."""
    kind = rows.schema["vector"].dataType.simpleString()
    keyed = rows.select("id", "vector", "since", "until").mapInArrow(_keys(seed), f"pass long, key long, id long, vector {kind}")
    ordered = keyed.repartitionByRange(parts, "pass", "key", "id").sortWithinPartitions("pass", "key", "id").select(F.spark_partition_id().cast("long").alias("part"), "pass", "id", "vector", "key")
    found = cut(ordered.mapInArrow(_windows(threshold, window), f"a long, b long, border long, pass long, side long, id long, vector {kind}"))
    across = found.where("border IS NOT NULL").select("border", "pass", "side", "id", "vector").groupBy("border", "pass").applyInArrow(_borders(threshold, window), "a long, b long")
    return found.where("a IS NOT NULL").select("a", "b").union(across), found.where("a IS NULL AND border IS NULL").select("id", F.col("pass").alias("bits"))


def _need(crowding: DataFrame, threshold: float) -> DataFrame:
    """(id, bits) -> (id, need): the passes after which a pair at the threshold has met with chance RECALL."""
    agree = F.avg(F.pow(F.lit(1 - math.acos(threshold) / math.pi), F.col("bits")))
    return crowding.groupBy("id").agg(F.ceil(F.lit(math.log(1 - RECALL)) / F.log(1 - F.least(agree, F.lit(0.95)))).alias("need"))


def _crowded(hot: DataFrame, n: int, threshold: float, window: int, parts: int, seed: int) -> DataFrame:
    """Edges among the ``n`` rows hot (id, vector) that lie too close for the common passes."""
    # Every pass has rows for some windows in each partition.
    spread = lambda rows: max(1, min(parts, rows // (4 * window)))
    edges, crowding = _passes(hot.withColumns({"since": F.lit(0), "until": F.lit(PROBES)}), threshold, window, spread(n * PROBES), seed)
    blocks = -(-n // BLOCK)
    need = cut(hot.join(_need(crowding, threshold), "id").where(F.col("need") > PROBES))
    # A copy of a row goes to each pass, or to each block: whichever is less.
    few = need.where(F.col("need") <= blocks).withColumns({"since": F.lit(PROBES), "until": F.col("need").cast("int")})
    total = few.agg(F.sum(F.col("until") - F.col("since"))).first()[0]
    if total:
        edges = edges.union(_passes(few, threshold, window, spread(total), seed)[0])
    all_of = need.where(F.col("need") > blocks)
    rest = all_of.count()
    if rest:
        own = -(-rest // BLOCK)
        every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
        first = all_of.select(F.pmod(F.xxhash64("id", F.lit("own")), F.lit(own).cast("long")).alias("i"), every(blocks).alias("j"), F.lit(0).alias("side"), "id", "vector")
        second = hot.select(every(own).alias("i"), F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")).alias("j"), F.lit(1).alias("side"), "id", "vector")
        cells = first.union(second)
        edges = edges.union(cells.withColumn("length", F.size("vector")).groupBy("i", "j", "length").applyInArrow(_across(threshold), "a long, b long"))
    return edges


def near_vectors(vectors: DataFrame, threshold: float = 0.9, window: int = WINDOW, passes: int | None = None, seed: int = 7) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> (vec_id, n_links, component_id, kept)."""
    # Single-precision vectors are sent as they are; products are in double precision either way.
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector")).where("vec_id IS NOT NULL")
    sound = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(sound, F.col("vector")))
    classes = cut(rows.where("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    n = classes.count()
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    common = passes or min(COMMON_PASSES, passes_for(n, threshold, window))
    edges, crowding = _passes(classes.withColumns({"since": F.lit(0), "until": F.lit(common)}), threshold, window, parts, seed)
    hot = cut(classes.join(_need(crowding, threshold).where(F.col("need") > 1.25 * common), "id").select("id", "vector"))
    n_hot = hot.count()
    if n_hot:
        edges = edges.union(_crowded(hot, n_hot, threshold, WIDE_WINDOW, parts, seed + 1))
    groups = components(edges)

    members = classes.join(groups, "id")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).alias("blocks"))
    placed = members.join(sizes, "component").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    first = placed.select("component", F.col("mine").alias("i"), F.explode(F.sequence("mine", F.col("blocks") - 1)).alias("j"), F.lit(0).cast("long").alias("side"), "id", "copies", "vector")
    second = placed.select("component", F.explode(F.sequence(F.lit(0).cast("long"), "mine")).alias("i"), F.col("mine").alias("j"), F.lit(1).cast("long").alias("side"), "id", "copies", "vector")
    cells = first.union(second).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "id")
    counted = cells.mapInArrow(_counts(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))

    per_class = classes.join(groups, "id", "left").join(counted, "id", "left").select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.where("vector IS NOT NULL").join(per_class, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
