"""Exact Jaccard self-join of documents on word shingles, as a T-occurrence search.

Two documents link when their sets of distinct five-word shingles have a Jaccard similarity of at
least ``num / den``. A document with s shingles must share T = ceil(s * num / den) of them with any
partner. DivideSkip sets the L = T - 1 longest inverted lists of a document aside (frequent shingles come
last in the order that all documents agree on) and merges the others, its first s - L shingles: partners turn
up there T - L times at least, and what is still missing is looked up in the long lists. Merging is a shuffle
and a sort-merge of runs: short lists go packed, as compressed arrays by slices of the shingles, lists that
many documents share as rows that Spark can split. Occurrences are counted by pair of documents, and a pair
goes on if its count reaches what the lists set aside leave open. Whether a candidate stands in the long lists
is then probed by binary search in its sorted set, until the overlap is out of reach.

Hot groups never turn into all their pairs. Equal sets collapse into one representative first. Then
each list links its members to one pivot; whoever verified links join is not compared again, and
only members of lists that still span several components are compared with each other, where the
places of the shared shingle in both sets leave room for the required overlap.

A candidate's sets are fetched only if their parity sketches allow the overlap: bits that differ are
no more than shingles that only one set has, so a pair that the sketches rule out can't link. Sketches grow
with the sets, so they tell long documents apart as well as short ones.

Nulls, empty texts and texts without words have an empty set and link with nothing; a text of
fewer than five words has its whole sequence as its one shingle. Repeated doc_ids count as one
document each time they have the same text. Extra columns are ignored. Shingles are compared by
64-bit hashes. What counts as frequent is found task by task; that estimate only steers the order,
never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .kernels import distinct_sorted, mix64, pieces, shingle_hashes, split_words, texts_of

#: A shingle found at least so often, counting tasks in which it stands three times, has a long list.
LONG_LIST = 8
#: Bound on the table of long lists that goes to every task, in entries of 12 bytes.
MOST_LONG = 1 << 18
#: Up to so many ids of candidates are broadcast; more are joined by a shuffle.
MOST_BROADCAST_IDS = 500_000
#: Least bits of the parity sketch of a set.
SKETCH = 1024
#: Candidates of one pivot that are verified by one task.
PIVOT_SHARE = 1000
#: Shingles that are probed at once.
PROBE = 512
#: Postings of a slice, and so about of what one task merges at once.
SLICE = 1 << 19
_TALLY = 3 << 20
_PACKED = ["slice", "postings", "lists"]


def _sets(texts, width):
    """Per run of texts: (index of the first, distinct sorted shingle hashes, first)."""
    for begin, run in pieces(texts):
        h, first = shingle_hashes(split_words(run), width)
        yield (begin, *distinct_sorted(h, first))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _sketches(v: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Per set, a bit for each bucket of its shingles' first bits: whether it holds an odd number of them. A set of n has n buckets, rounded up to a power of two, SKETCH at least."""
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        bits = max(SKETCH.bit_length() - 1, (b - a - 1).bit_length())
        out.append(np.packbits(np.bincount((v[a:b] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).tobytes())
    return out


def _differing(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the longer is folded to the shorter's buckets."""
    p, q = (np.frombuffer(z, np.uint8) for z in sorted((x, y), key=len))
    while len(q) > len(p):
        q = np.packbits(np.unpackbits(q).reshape(-1, 2).sum(1) & 1)
    return int(np.bitwise_count(p ^ q).sum())


def _shortened(v: np.ndarray) -> bytes:
    """The first six bytes of each shingle. Lists that fall together this way only add candidates."""
    return v.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _lengthened(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(">u8").reshape(-1).astype(np.uint64)


def _byte_planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones: what is mostly zero compresses away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(raw: bytes, t) -> np.ndarray:
    width = np.dtype(t).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(t)


_PROFILE = ["doc_id", "mark", "n", "hi", "lo", "sketch", "token", "c"]


def _profile(width: int):
    """Documents (doc_id, text, mark) -> a row for each (doc_id, mark, n, hi, lo, sketch), and rows (token, c) for shingles that a task sees often."""

    def tally(v):
        # Sorted in place, and counted only where a shingle stands three times: a task's memory stays near that of the tally itself.
        v.sort()
        at = np.flatnonzero(v[2:] == v[:-2])
        at = at[np.concatenate((np.ones(1, bool), v[at[1:]] != v[at[1:] - 1]))] if len(at) else at
        tokens = v[at]
        c = np.searchsorted(v, tokens, "right") - at
        k = len(at)
        gone = pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays([gone, gone, gone, gone, gone, pa.nulls(k, pa.binary()), pa.array(_signed(tokens)), pa.array(c.astype(np.int64))], _PROFILE)

    def of(batches):
        seen, size = np.empty(_TALLY, np.uint64), 0
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            for begin, v, first in _sets(texts_of(batch.column(1)), width):
                n = np.diff(first)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)))
                other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(v), dtype=np.uint64)))
                gone = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, len(n)), marks.slice(begin, len(n)), pa.array(n), pa.array(_signed(total[first[1:]] - total[first[:-1]])), pa.array(_signed(other[first[1:]] - other[first[:-1]])), pa.array(_sketches(v, first), pa.binary()), gone, gone],
                    _PROFILE,
                )
                while len(v):
                    some = v[: _TALLY - size]
                    seen[size : size + len(some)] = some
                    size, v = size + len(some), v[len(some) :]
                    if size == _TALLY:
                        yield tally(seen)
                        size = 0
        if size:
            yield tally(seen[:size])

    return of


def _prefixes(width: int, num: int, den: int, shared):
    """Documents -> (doc_id, n, hi, lo, tokens): the first s - T + 1 shingles, those with long lists last."""

    def of(batches):
        long_tokens, often = shared.value
        for batch in batches:
            ids = batch.column(0)
            for begin, v, first in _sets(texts_of(batch.column(1)), width):
                n = np.diff(first)
                take = n - (n * num + den - 1) // den + (n > 0)
                at = np.searchsorted(long_tokens, v)
                rank = np.where((at < len(long_tokens)) & (long_tokens[np.minimum(at, len(long_tokens) - 1)] == v), often[np.minimum(at, len(long_tokens) - 1)], 0) if len(long_tokens) else np.zeros(len(v), np.int64)
                some_long = np.add.reduceat(np.append(rank, 0), np.minimum(first[:-1], len(rank))) * (n > 0)
                out = []
                for i in np.flatnonzero(n):
                    a, b = first[i], first[i + 1]
                    # v ascends already; a stable sort by rank keeps that order within a rank.
                    out.append(v[a : a + take[i]] if not some_long[i] else v[a:b][np.argsort(rank[a:b], kind="stable")[: take[i]]])
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)))
                other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(v), dtype=np.uint64)))
                end = 6 * np.cumsum(take)
                raw = _shortened(np.concatenate(out)) if out else b""
                tokens = pa.array([raw[b - 6 * k : b] for b, k in zip(end.tolist(), take.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, len(n)), pa.array(n), pa.array(_signed(total[first[1:]] - total[first[:-1]])), pa.array(_signed(other[first[1:]] - other[first[:-1]])), tokens],
                    ["doc_id", "n", "hi", "lo", "tokens"],
                )

    return of


def _flat(batch, long_tokens: np.ndarray, is_long: bool):
    """(doc, n, tokens) -> shingles, their places and rows, of those only that have (or don't have) a long list."""
    raw = batch.column(2).to_pylist()
    size = np.array([len(x) // 6 for x in raw], np.int64)
    tokens = _lengthened(b"".join(raw))
    row = np.repeat(np.arange(len(raw)), size)
    place = np.arange(len(tokens)) - (np.cumsum(size) - size)[row]
    if len(long_tokens):
        short = long_tokens & ~np.uint64(0xFFFF)
        keep = (short[np.minimum(np.searchsorted(short, tokens), len(short) - 1)] == tokens) == is_long
    else:
        keep = np.full(len(tokens), not is_long)
    return tokens[keep], place[keep], row[keep]


def _long_postings(shared):
    """(doc, n, tokens) -> (token, doc, n_place) of shingles with long lists; n and the place in the prefix share one number."""

    def of(batches):
        for batch in batches:
            tokens, place, row = _flat(batch, shared.value[0], True)
            doc, n = (np.asarray(batch.column(k))[row] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(tokens)), pa.array(doc), pa.array((n << 32) + place)], ["token", "doc", "n_place"])

    return of


def _packed_postings(shared, slices: int):
    """(doc, n, tokens) -> for each slice of the shingles with short lists: how many postings, and their shingles, places, documents and sizes, compressed."""

    def of(batches):
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(np.asarray(batch.column(0)), kind="stable")))
            tokens, place, row = _flat(batch, shared.value[0], False)
            doc, n = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.int32)
            part = ((mix64(tokens) >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            tokens, place, row, part = tokens[order], place[order].astype(np.int32), row[order], part[order]
            edge = np.flatnonzero(np.diff(part, prepend=-1, append=slices))
            out = []
            for a, b in zip(edge, edge[1:]):
                own = row[a:b]
                # Documents ascend, so their differences are small.
                raw = [_shortened(tokens[a:b]), _byte_planes(place[a:b]), _byte_planes(np.diff(doc[own], prepend=0)), _byte_planes(np.diff(n[own], prepend=np.int32(0)))]
                out.append((int(part[a]), int(b - a), pa.compress(b"".join(raw), codec="zstd", asbytes=True)))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], _PACKED)

    return of


def _merged(batches):
    """Packed postings sorted by slice -> (token, doc, n, place, a) of shingles that several documents share, a the least of them."""

    def merge(parts):
        tokens, place, doc, n = [], [], [], []
        for _, k, packed in parts:
            raw = pa.decompress(packed, 22 * k, codec="zstd", asbytes=True)
            tokens.append(_lengthened(raw[: 6 * k]))
            place.append(_from_planes(raw[6 * k : 10 * k], np.int32))
            doc.append(np.cumsum(_from_planes(raw[10 * k : 18 * k], np.int64)))
            n.append(np.cumsum(_from_planes(raw[18 * k :], np.int32), dtype=np.int32))
        tokens, place, doc, n = (np.concatenate(x) for x in (tokens, place, doc, n))
        order = np.argsort(tokens, kind="stable")
        tokens, doc = tokens[order], doc[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        least = np.minimum.reduceat(doc, first)
        keep = (least < np.maximum.reduceat(doc, first))[group]
        return pa.RecordBatch.from_arrays([pa.array(_signed(tokens[keep])), pa.array(doc[keep]), pa.array(n[order][keep].astype(np.int64)), pa.array(place[order][keep].astype(np.int64)), pa.array(least[group][keep])], ["token", "doc", "n", "place", "a"])

    held = []
    for batch in batches:
        for x in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if held and held[0][0] != x[0]:
                yield merge(held)
                held = []
            held.append(x)
    if held:
        yield merge(held)


def _possible(num: int, den: int):
    """Pairs with sizes and sketches (a, na, x, b, nb, y) -> pairs that may link: at most na + nb - 2 * need shingles may be in one set only."""

    def of(batches):
        for batch in batches:
            na, nb = (np.asarray(batch.column(k)).astype(np.int64) for k in (1, 4))
            need = ((na + nb) * num + num + den - 1) // (num + den)
            differ = np.array([_differing(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist())], np.int64)
            ok = differ <= na + nb - 2 * need
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(ok))

    return of


def _arrays(width: int):
    """(key, salt, side, doc_id, text) -> (key, salt, side, doc, set)."""

    def of(batches):
        for batch in batches:
            for begin, v, first in _sets(texts_of(batch.column(4)), width):
                columns = [batch.column(k).slice(begin, len(first) - 1) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([v[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], ["key", "salt", "side", "doc", "set"])

    return of


def _overlaps(num: int, den: int):
    """Rows (key, salt, side, doc, set), each pivot (side 0) before its candidates (side 1) -> pairs that link.

    The shorter set's shingles are probed in the longer by binary search.
    """

    def links(p, q):
        if len(p) > len(q):
            p, q = q, p
        if not len(p):
            return False
        need = -(-(len(p) + len(q)) * num // (num + den))
        common = 0
        for a in range(0, len(p), PROBE):
            if common + len(p) - a < need:
                return False
            some = p[a : a + PROBE]
            common += int((q[np.minimum(np.searchsorted(q, some), len(q) - 1)] == some).sum())
        return common > 0 and den * common >= num * (len(p) + len(q) - common)

    def of(batches):
        pivots, mine = [], None
        for batch in batches:
            out = []
            for key, salt, side, doc, got in zip(*(batch.column(k).to_pylist() for k in range(5))):
                own = np.frombuffer(got, np.uint64)
                if (key, salt) != mine:
                    pivots, mine = [], (key, salt)
                if side == 0:
                    pivots.append(own)
                elif any(links(p, own) for p in pivots):
                    out.append((key, doc))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return of


def _need(n, m, num, den):
    """Shingles that sets of sizes n and m must share at least."""
    return F.floor(((n + m) * num + num + den - 1) / F.lit(num + den))


def _reaching(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """pairs: (a, na, b, nb, c), c shingles shared within both prefixes. Keeps those that can still reach the required overlap."""
    need = _need(F.col("na"), F.col("nb"), num, den)
    rest = F.greatest(F.floor((F.col("na") * num + den - 1) / den), F.floor((F.col("nb") * num + den - 1) / den)) - 1
    return pairs.where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (F.col("c") >= need - rest))


def _mark(docs: DataFrame):
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64("text")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_shingles, component_id): the size of each document's set, and the least doc_id that links reach."""
    return _marked_components(docs, width, num, den).drop("mark")


def _marked_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """As jaccard_components, with each row's mark."""
    docs = docs.select("doc_id", "text", _mark(docs).alias("mark")).where("doc_id IS NOT NULL")
    spark = docs.sparkSession
    profile = cut(docs.mapInArrow(_profile(width), "doc_id long, mark long, n long, hi long, lo long, sketch binary, token long, c long"))
    often = profile.where("token IS NOT NULL").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= LONG_LIST).orderBy(F.desc("c"), "token").limit(MOST_LONG).toPandas()
    long_tokens = often["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(long_tokens)
    shared = spark.sparkContext.broadcast((long_tokens[order], often["c"].to_numpy(np.int64)[order]))

    # Equal sets have the same prefix; one representative stands for them all.
    reps = docs.mapInArrow(_prefixes(width, num, den, shared), "doc_id long, n long, hi long, lo long, tokens binary").where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("doc"), F.any_value("tokens").alias("tokens"))
    listed = reps.select("doc", "n", "tokens")
    postings = listed.mapInArrow(_long_postings(shared), "token long, doc long, n_place long")
    lists = postings.groupBy("token").agg(F.min("doc").alias("a"), F.max("doc").alias("last")).where("a < last").select("token", "a")
    long_ones = postings.join(lists, "token").select("token", "doc", F.shiftright("n_place", 32).alias("n"), F.col("n_place").bitwiseAND((1 << 32) - 1).alias("place"), "a")
    taken = profile.where("n > 0").agg(F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1), F.lit(0))).first()[0]
    packed = listed.mapInArrow(_packed_postings(shared, max(1, -(-int(taken) // SLICE))), "slice long, postings long, lists binary")
    short_ones = packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merged, "token long, doc long, n long, place long, a long")
    members = cut(long_ones.union(short_ones))
    del reps, listed, postings, lists, packed  # lets Spark drop their shuffle files
    sizes = members.groupBy(F.col("doc").alias("a")).agg(F.first("n").alias("na"))

    sketches = profile.where("n > 0").select("doc_id", "n", "sketch")

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = sketches.toDF("a", "na", "x"), sketches.toDF("b", "nb", "y")
        near = cut(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "na", "x", "b", "nb", "y").mapInArrow(_possible(num, den), "a long, b long").distinct())
        salts = near.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(PIVOT_SHARE))).alias("salts"))
        candidates = near.join(salts, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.lit(1).alias("side"))
        pivots = salts.select(F.col("a").alias("doc_id"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"))
        wanted = cut(candidates.union(pivots))
        wanted = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST_IDS else wanted
        sets = docs.join(wanted, "doc_id").select("key", "salt", "side", "doc_id", "text").mapInArrow(_arrays(width), "key long, salt long, side int, doc long, set binary")
        return cut(sets.repartition("key", "salt").sortWithinPartitions("key", "salt", "side", "doc").mapInArrow(_overlaps(num, den), "a long, b long").distinct())

    def star(m: DataFrame) -> DataFrame:
        got = m.where("doc <> a").groupBy("a", F.col("doc").alias("b")).agg(F.first("n").alias("nb"), F.count("*").alias("c"))
        return cut(_reaching(got.join(sizes, "a"), num, den).select("a", "b"))

    tested = star(members)
    links = verified(tested)
    groups = components(links)
    now = members.select("token", "doc", "n", "place").join(groups.select(F.col("id").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    several = now.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("token")
    left = cut(now.join(several, "token"))
    # The first shingle that two linked documents share stands early enough in both to leave room for
    # the overlap; in the smaller one, that is within the room that a partner of its own size leaves.
    small = left.where(F.col("n") - F.col("place") >= _need(F.col("n"), F.col("n"), num, den)).select("token", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("component").alias("ka"))
    large = left.select("token", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("component").alias("kb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= _need(F.col("na"), F.col("nb"), num, den)
    cross = small.join(large, "token").where(smaller & (F.col("ka") != F.col("kb")) & (F.col("na") * den >= F.col("nb") * num) & room).select("a", "b").distinct()
    known = tested.union(tested.select("b", "a"))
    rest = verified(cut(cross.join(known, ["a", "b"], "left_anti")))
    groups = components(links.union(rest)) if rest.limit(1).count() else groups

    own = profile.where("token IS NULL").select("doc_id", "mark", "n", "hi", "lo")
    whole = own.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("id")).join(groups, "id", "left").select("hi", "lo", "n", F.coalesce("component", "id").alias("component"))
    return own.join(whole, ["hi", "lo", "n"], "left").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Of each component the rows with the least doc_id stay, each text of theirs once; all columns stay.

    Rows without a doc_id stay, and so do rows whose text has no words, as they link with nothing. Rows that
    share a doc_id are told apart by their texts; a component whose least doc_id has several texts keeps them all.
    """
    groups = cut(_marked_components(docs, **options).where("n_shingles > 0"))
    gone = cut(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct())
    twice = cut(groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).count().where("count > 1").drop("count"))
    # Ids go to the tasks only up to a bound; beyond it both sides are shuffled.
    bounded = lambda rows: F.broadcast(rows) if rows.count() <= MOST_BROADCAST_IDS else rows
    same = (F.col("doc_id") == F.col("_id")) & (_mark(docs) == F.col("_mark"))
    kept = docs.join(bounded(gone), same, "left_anti")
    if twice.limit(1).count():
        again = bounded(twice)
        one = kept.join(again, same, "left_semi").groupBy("doc_id", _mark(docs)).agg(F.any_value(F.struct(*docs.columns)).alias("_row")).select("_row.*")
        kept = kept.join(again, same, "left_anti").unionByName(one)
    return kept.select(*docs.columns)
