"""Vectorised text kernels shared by the corpus operators.

Everything here works on a *batch* of texts laid out as one UTF-8 buffer, so that the cost
per byte is a few array operations and never a Python call per word.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

#: Multiplier of the polynomial word hash; odd, so that it has an inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Multiplier that chains word hashes into shingles.
_CHAIN = np.uint64(0xD6E8FEB86659FD93)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_DARK = ~_WHITE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = LOWER.astype(np.uint64) + np.uint64(1)
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Bytes of text that are handled in one piece; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int, base: np.uint64, name: str) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        steps = np.full(max(n, PIECE_BYTES + (PIECE_BYTES >> 2)), base, np.uint64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
        if len(table) <= 2 * PIECE_BYTES:
            _powers[name] = table
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values, so that any bits of the result may be used."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of a run of texts: hash, byte range in ``buffer``, and ``first[i]:first[i+1]`` is text i's."""

    buffer: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def pieces(texts: Iterable[str | None], limit: int = PIECE_BYTES):
    """Encodes texts and groups them, in order, into runs of at most ``limit`` bytes: (index of the first, list of bytes)."""
    run: list[bytes] = []
    size = begin = 0
    k = -1
    for k, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if run and size + len(data) > limit:
            yield begin, run
            run, size, begin = [], 0, k
        run.append(data)
        size += len(data) + 1
    if run:
        yield begin, run


def texts_of(column):
    """The texts of an Arrow column one after another, so that a batch isn't held twice."""
    return (x.as_py() for x in column)


def split_words(run: list[bytes], plain: bool = False) -> Words:
    """Splits a run into words and hashes them.

    Words are maximal runs without the six ASCII white-space bytes, A-Z lower-cased. With
    ``plain``, ASCII punctuation separates words too, so decoration does not hide a copy.
    """
    buffer = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
    offsets = np.zeros(len(run) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in run], out=offsets[1:])
    # A separator stands after each text, so that no word crosses two texts. Long buffers go in parts
    # that end between words, so that what is needed for each byte is bounded.
    inside = _PLAIN if plain else _DARK
    found, at = [], 0
    while at < len(buffer):
        end = min(len(buffer), at + 2 * PIECE_BYTES)
        while end < len(buffer) and inside[buffer[end - 1]]:
            end += 1
        found.append(_hash_words(buffer[at:end], inside, at))
        at = end
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found))
    return Words(buffer, offsets, hashes, starts, ends, np.searchsorted(starts, offsets))


def _hash_words(buffer: np.ndarray, inside: np.ndarray, at: int):
    """Hashes, starts and ends (both moved by ``at``) of the words of a buffer that ends between words."""
    dark = inside[buffer]
    edge = np.flatnonzero(dark[1:] != dark[:-1]) + 1
    if dark[0]:
        edge = np.concatenate(([0], edge))
    if dark[-1]:
        edge = np.concatenate((edge, [len(buffer)]))
    starts, ends = edge[0::2], edge[1::2]
    n = len(buffer)
    value = _VALUE[buffer]
    value *= _power_table(n, _BASE, "up")[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    down = _power_table(n, _BASE_INVERSE, "down")
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts + at, ends + at


def shingle_hashes(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` words in a row, text by text: (hashes, first).

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    h, first = words.hashes, words.first
    count = np.diff(first)
    n_out = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_first = np.concatenate(([0], np.cumsum(n_out)))
    owner = np.repeat(np.arange(len(count)), n_out)
    at = np.arange(out_first[-1]) - out_first[owner] + first[owner]
    length = np.minimum(count[owner], width)
    acc = np.zeros(len(at), np.uint64)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    for j in range(width):
        acc = acc * _CHAIN + np.where(j < length, padded[at + j], np.uint64(0))
    return mix64(acc + length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), out_first


def distinct_sorted(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts each group's values and drops repeats: (values, first)."""
    v = values.copy()
    bounds = first.tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b - a > 1:
            v[a:b].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    keep[first[:-1][first[:-1] < len(v)]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return v[keep], kept[first]


def code_point_offset(data: bytes, at: int) -> int:
    """Code points before byte ``at`` of a UTF-8 text."""
    return len(data[:at].decode("utf-8", "surrogatepass"))
