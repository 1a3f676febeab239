"""Finds benchmark items inside documents: SimHash windows, multi-index Hamming search, exact verification.

Words are runs of letters and digits, lower-cased in every script, so case and decoration don't hide a
copy. For an item of n five-word shingles, every window of n shingles of every document is a candidate. A window's
64-bit SimHash is looked up among the SimHashes of the items of its size through a multi-index: for each of
eight blocks of eight bits, items sorted by that block, probed with all values within RADIUS // 8 bits of the
window's, which by the pigeonhole principle misses no fingerprint within RADIUS. What is found is verified exactly, by the
weighted Jaccard similarity of the shingle multisets.

Most windows needn't be fingerprinted: a window that could reach the threshold must hold at least
that share of shingles which occur in some item, an exact bound read off a running sum.

The benchmark is the stated query set. It is sent to the tasks in blocks of bounded size; a larger
benchmark means more passes over the documents. An item or document of fewer than five words has no
shingle and matches nothing; nulls count as empty. Repeated items and repeated documents are each
reported. Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import pieces, shingle_hashes, split_words

WIDTH = 5
#: Punctuation beyond ASCII that separates words too.
_MARKS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f\uff01-\uff0f]+")
#: Fingerprints that differ in at most so many of 64 bits are candidates. At a similarity of 0.8 about 10 bits differ.
RADIUS = 16
#: Bounds on the part of the benchmark that is sent to the tasks at once.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 20_000_000
_FILTER_BITS = 23
_STEP = 4096

#: Bytes within RADIUS // 8 bits of zero; a byte's ball is these, each flipped onto it.
_BALL = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= RADIUS // 8).astype(np.uint8)
_BITS64 = np.arange(64, dtype=np.uint64)


def _folded(texts):
    """Texts in lower case, with a space for each mark beyond ASCII."""
    return (t if t is None else t.lower() if t.isascii() else _MARKS.sub(" ", t.lower()) for t in texts)


def _fingerprints(running: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHashes, as eight bytes each, of windows of n shingles. running: sums of the shingles' signs up to each position."""
    return np.packbits(running[starts + n] > running[starts], axis=1)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """Running sums, with a leading zero row, of each shingle's 64 signs."""
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(((hashes[:, None] >> _BITS64) & np.uint64(1)).astype(np.int32) * 2 - 1, axis=0, out=out[1:])
    return out


def _weights(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset of shingles: distinct hashes and how often each occurs."""
    return np.unique(hashes, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    (x, p), (y, q) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int(np.where(y[at] == x, np.minimum(p, q[at]), 0).sum())
    return common / (int(p.sum()) + int(q.sum()) - common)


class _Blocks:
    """The multi-index of one size: for each of the eight blocks of the fingerprints, items sorted by that block."""

    def __init__(self, items: np.ndarray, prints: np.ndarray):
        self.items, self.prints = items, prints
        self.order = [np.argsort(prints[:, b], kind="stable") for b in range(8)]
        self.first = [np.searchsorted(prints[o, b], np.arange(257)) for b, o in enumerate(self.order)]

    def within(self, prints: np.ndarray):
        """(window, item) pairs of fingerprints within RADIUS: if two differ in no more bits, some block differs in RADIUS // 8 at most.

        A pair is taken at the first such block only, so it comes once.
        """
        for b in range(8):
            probe = (prints[:, b][:, None] ^ _BALL).astype(np.int64)
            begin, end = self.first[b][probe], self.first[b][probe + 1]
            n = (end - begin).ravel()
            if not n.any():
                continue
            window = np.repeat(np.arange(len(prints)), n.reshape(len(prints), -1).sum(1))
            at = np.arange(n.sum()) + np.repeat(begin.ravel() - (np.cumsum(n) - n), n)
            other = self.order[b][at]
            differ = np.bitwise_count(prints[window] ^ self.prints[other])
            ok = (differ.sum(1) <= RADIUS) & (differ[:, :b] > RADIUS // 8).all(1)
            yield from zip(window[ok].tolist(), self.items[other[ok]].tolist())


class _Index:
    """A block of the benchmark: its shingles, and by size its items' fingerprints."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        parts = []
        for _, run in pieces(_folded(texts)):
            words = split_words(run, plain=True)
            h, first = shingle_hashes(words, WIDTH)
            enough = np.diff(words.first) >= WIDTH
            parts += [h[a:b] if ok else h[:0] for a, b, ok in zip(first, first[1:], enough)]
        self.sets = [_weights(h) for h in parts]
        self.known = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.known >> np.uint64(64 - _FILTER_BITS)] = True
        self.sizes: dict[int, _Blocks] = {}
        by: dict[int, list[int]] = {}
        for i, h in enumerate(parts):
            if len(h):
                by.setdefault(len(h), []).append(i)
        for n, items in sorted(by.items()):
            prints = np.concatenate([_fingerprints(_signs(parts[i]), np.zeros(1, int), n) for i in items])
            self.sizes[n] = _Blocks(np.array(items), prints)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = self.filter[h >> np.uint64(64 - _FILTER_BITS)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
            out[maybe] = self.known[at] == h[maybe]
        return out


def _matches(index: _Index, h: np.ndarray, hit: np.ndarray, least: float):
    """Best window of each item in one document: item index -> (similarity, start, n)."""
    best: dict[int, tuple[float, int, int]] = {}
    run = np.concatenate(([0], np.cumsum(hit)))
    for n in index.sizes:
        if n > len(h):
            starts = np.zeros(1, int) if run[-1] >= least * len(h) and len(h) >= least * n else np.zeros(0, int)
            width = len(h)
        else:
            starts = np.flatnonzero(run[n:] - run[:-n] >= least * n)
            width = n
        if not len(starts):
            continue
        # Fingerprints are made over short stretches, so a very long text needs no more memory than a short one.
        cuts = np.flatnonzero((np.diff(starts) > _STEP) | (np.diff(starts // _STEP) > 0)) + 1
        for group in np.split(starts, cuts):
            base = group[0]
            running = _signs(h[base : group[-1] + width])
            for w, item in index.sizes[n].within(_fingerprints(running, group - base, width)):
                at = int(group[w])
                s = similarity(_weights(h[at : at + width]), index.sets[item])
                if s >= least and (item not in best or (s, -at) > (best[item][0], -best[item][1])):
                    best[item] = (s, at, width)
    return best


def _scan(shared, least: float):
    def of(batches):
        index = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for begin, run in pieces(_folded(batch.column(1).to_pylist())):
                words = split_words(run, plain=True)
                h, first = shingle_hashes(words, WIDTH)
                hit = index.holds(h)
                if not hit.any():
                    continue
                count = np.diff(words.first)
                for k in np.unique(np.searchsorted(first, np.flatnonzero(hit), side="right") - 1).tolist():
                    if count[k] >= WIDTH:
                        for item, (s, at, n) in _matches(index, h[first[k] : first[k + 1]], hit[first[k] : first[k + 1]], least).items():
                            out.append((ids[begin + k], int(index.ids[item]), s, at, n + WIDTH - 1))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return of


def _clean(shared, at: int, least: float):
    """Batches without the rows that hold an item; ``at`` is the text's column."""

    def of(batches):
        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for begin, run in pieces(_folded(batch.column(at).to_pylist())):
                words = split_words(run, plain=True)
                h, first = shingle_hashes(words, WIDTH)
                hit = index.holds(h)
                count = np.diff(words.first)
                for k in np.unique(np.searchsorted(first, np.flatnonzero(hit), side="right") - 1).tolist():
                    if count[k] >= WIDTH and _matches(index, h[first[k] : first[k + 1]], hit[first[k] : first[k + 1]], least):
                        keep[begin + k] = False
            yield batch.filter(pa.array(keep))

    return of


def _indexes(benchmark: DataFrame):
    """The benchmark as broadcast indexes of bounded size."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        rows = part.orderBy("item_id").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(_Index([r[0] for r in rows], [r[1] for r in rows]))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text, ...) -> the best window of each item in each document that reaches ``least``.

    Columns: doc_id, item_id, similarity, start_word, n_words (positions count words of letters and digits).
    """
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = [docs.mapInArrow(_scan(shared, least), "doc_id long, item_id long, similarity double, start_word long, n_words long") for shared in _indexes(benchmark)]
    return reduce(DataFrame.union, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """Drops documents that hold a benchmark item, each row by its own text, without a shuffle; all columns stay. Rows without a doc_id are judged too."""
    for shared in _indexes(benchmark):
        docs = docs.mapInArrow(_clean(shared, docs.columns.index("text"), least), docs.schema)
    return docs
