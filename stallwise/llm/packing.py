"""Best-fit packing of documents into training sequences of several permitted lengths.

Lengths are counted in UTF-8 bytes and one end mark by default, as a byte-level model reads them; any
column of token counts may be given instead. A document longer than the largest sequence is cut into
pieces of that length and a remainder, so nothing is lost.

Pieces are dealt by a hash over shards of about SHARD pieces, enough for a packing within a fraction of
a percent of the best and little enough for one task, however large the corpus or any source is. In a
shard, pieces go in falling length into the open bin that they fill best. When none fits, a bin is
opened: of the permitted lengths that hold the piece, the one that costs least for each token it is
expected to hold. All opening policies (each permitted length as the least that is opened) are tried
and the cheapest whole packing is kept, so the lengths are optimised jointly. Finally every bin shrinks
to the shortest permitted length that holds its contents.

Rows without a doc_id are packed too, with a null in its place. Null or empty texts have only the end mark. Repeated rows are packed
each. Extra columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LENGTHS = (2048, 4096, 8192, 16384)
#: A sequence of n tokens costs n * (1 + n / ATTENTION) + OVERHEAD.
ATTENTION, OVERHEAD = 65536, 64
SHARD = 20_000


def cost(length: int) -> float:
    return length * (1 + length / ATTENTION) + OVERHEAD


def _open(size: int, least: int, left: int, lengths: tuple[int, ...]) -> int:
    """The permitted length to open for a piece: the least cost for each token it will hold, if what is left to place can fill it."""
    fits = [c for c in lengths if c >= max(size, min(least, lengths[-1]))]
    return min(fits, key=lambda c: (cost(c) / min(c, size + left), c))


def _fill(sizes: list[int], least: int, lengths: tuple[int, ...]) -> tuple[float, list[int], list[int]]:
    """Best fit of falling sizes: (total cost after shrinking, bin of each piece, final length of each bin)."""
    room: list[int] = []  # distinct free sizes, ascending
    bins_of: dict[int, list[int]] = {}
    used: list[int] = []
    place: list[int] = []
    left = sum(sizes)
    for size in sizes:
        left -= size
        k = bisect.bisect_left(room, size)
        if k < len(room):
            free = room[k]
            own = bins_of[free]
            b = own.pop()
            if not own:
                del bins_of[free]
                room.pop(k)
        else:
            b, free = len(used), _open(size, least, left, lengths)
            used.append(0)
        used[b] += size
        place.append(b)
        free -= size
        if free:
            if free not in bins_of:
                bisect.insort(room, free)
                bins_of[free] = []
            bins_of[free].append(b)
    final = [lengths[bisect.bisect_left(lengths, u)] for u in used]
    return sum(map(cost, final)), place, final


def pack_sizes(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int]]:
    """sizes in falling order, none above the largest length -> (bin of each piece, final length of each bin)."""
    tries = [_fill(sizes, least, lengths) for least in lengths]
    return min(tries, key=lambda t: t[0])[1:]


def _shards(lengths: tuple[int, ...]):
    """Rows (shard, n, doc_id, piece, start) sorted by shard and falling n -> rows with bin_id, capacity, used, slot, offset."""

    def flush(parts):
        t = pa.Table.from_batches(parts)
        sizes = t["n_tokens"].to_pylist()
        place, final = pack_sizes(sizes, lengths)
        place, sizes = np.array(place), np.array(sizes)
        used = np.bincount(place, sizes, len(final)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(final)))))
        offset, slot = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        run = np.cumsum(sizes[order]) - sizes[order]
        offset[order] = run - run[first[place[order]]]
        slot[order] = np.arange(len(place)) - first[place[order]]
        shard = t["shard"][0].as_py()
        columns = [pa.array((shard << 32) + place.astype(np.int64)), pa.array(np.array(final, np.int64)[place]), pa.array(used[place]), pa.array(slot), pa.array(offset)]
        return pa.table([*columns, t["doc_id"].combine_chunks(), t["piece"].combine_chunks(), t["start"].combine_chunks(), t["n_tokens"].combine_chunks()], ["bin_id", "capacity", "used", "slot", "offset", "doc_id", "piece", "start", "n_tokens"])

    def of(batches):
        held, mine = [], None
        for batch in batches:
            shard = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)] if len(shard) else []
            for a, b in zip(edges, edges[1:]):
                if held and shard[a] != mine:
                    yield from flush(held).to_batches()
                    held = []
                mine = shard[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush(held).to_batches()

    return of


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, tokens: Column | None = None, shard: int = SHARD) -> DataFrame:
    """docs (doc_id, text, ...) -> a row for each piece: bin_id, capacity, used, slot, offset (in the bin), doc_id, piece, start (in the document), n_tokens."""
    lengths = tuple(sorted(lengths))
    n = F.coalesce(F.octet_length("text"), F.lit(0)) + 1 if tokens is None else tokens
    most = lengths[-1]
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n")).where("n > 0")
    pieces = cut(sized.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))).alias("piece", "start")).select("doc_id", F.col("piece").cast("long").alias("piece"), "start", F.least(F.col("n") - F.col("start"), F.lit(most)).alias("n_tokens")))
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.select(F.pmod(F.xxhash64("doc_id", "piece", F.lit("shard")), F.lit(shards)).alias("shard"), "n_tokens", "doc_id", "piece", "start")
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece")
    return ordered.mapInArrow(_shards(lengths), "bin_id long, capacity long, used long, slot long, offset long, doc_id long, piece long, start long, n_tokens long")
