"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks (CHUNK bytes, half of each shared with the next)
that cover the whole text. WIDTH bytes under each filter, a step of STEP apart, are embedded and
convolved in one go: a filter is a table with a value for each byte at each of its places. Rectified
outputs are max-pooled in each chunk; the chunks' pooled values are combined by their mean and maximum
and weighed into one probability.

The filters are learned by Adam on a bounded sample of labelled rows outside the held-out fold (at
most about LABELLED rows, TRAIN_CHUNKS chunks from all over each); then the last layer is fitted on
features of those rows' whole texts, made just as in scoring, which also calibrates it. Labels, lang,
source and doc_id are no inputs.

Nulls count as empty, and an empty text is one blank chunk. Rows without a doc_id are left out,
repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample
from .toxicity import fit_logistic

LABELLED = 4000
CHUNK, STEP, WIDTH, FILTERS = 512, 4, 8, 16
TRAIN_CHUNKS = 8
EPOCHS, BATCH, RATE = 5, 64, 0.01
_HALF = CHUNK // 2
_PER_HALF = _HALF // STEP
_RUN = 1 << 18


def _halves(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to half chunks, at least two each: (bytes, first half of each text)."""
    count = [max(2, -(-len(x) // _HALF)) for x in run]
    first = np.concatenate(([0], np.cumsum(count)))
    return np.frombuffer(b"".join(x.ljust(c * _HALF, b"\0") for x, c in zip(run, count)), np.uint8), first


def _convolve(data: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Outputs of all filters, at every STEP bytes; the last places see zero bytes beyond the end."""
    data = np.concatenate((data, np.zeros(WIDTH, np.uint8)))
    n = (len(data) - WIDTH) // STEP
    out = filters[0][data[: n * STEP : STEP]]
    for j in range(1, WIDTH):
        out += filters[j][data[j : j + n * STEP : STEP]]
    return out


def features(texts: list[bytes], filters: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Mean and maximum over a text's overlapping chunks of each filter's maximum within the chunk."""
    out = np.zeros((len(texts), 2 * FILTERS), np.float32)
    run, begin, size = [], 0, 0

    def flush():
        data, first = _halves(run)
        pooled = np.empty((first[-1], FILTERS), np.float32)
        step = _RUN // _HALF
        for a in range(0, first[-1], step):
            b = min(first[-1], a + step)
            # The next half's bytes stand behind this stretch, as they do in the text.
            part = _convolve(data[a * _HALF : b * _HALF + (WIDTH if b < first[-1] else 0)], filters)[: (b - a) * _PER_HALF]
            part = part.reshape(b - a, _PER_HALF, FILTERS)
            # The last place of a text would look into the next one, as that of a training chunk would.
            ends = first[1:] - 1 - a
            part[ends[(ends >= 0) & (ends < b - a)], -((WIDTH - STEP) // STEP) :] = -9
            pooled[a:b] = part.max(1)
        chunk = np.maximum(np.maximum(pooled[:-1], pooled[1:]) + bias, 0)
        owner = first[:-1]
        # A text of h halves has h - 1 chunks; the row that joins two texts is left out by a neutral value.
        seams = first[1:-1] - 1
        if len(seams):
            chunk[seams] = 0
        chunk = np.concatenate((chunk, np.zeros((1, FILTERS), np.float32)))
        out[begin : begin + len(run), :FILTERS] = np.add.reduceat(chunk, owner) / (np.diff(first) - 1)[:, None]
        out[begin : begin + len(run), FILTERS:] = np.maximum.reduceat(chunk, owner)

    for k, text in enumerate(texts):
        if run and size + len(text) > _RUN:
            flush()
            run, begin, size = [], k, 0
        run.append(text)
        size += len(text) + _HALF
    if run:
        flush()
    return out


def _encoded(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


def _examples(batches):
    """(doc_id, label, text) -> (doc_id, label, chunks): TRAIN_CHUNKS chunks spread evenly over the whole text."""
    for batch in batches:
        out = []
        for text in _encoded(batch.column(2)):
            last = max(0, len(text) - CHUNK)
            at = sorted({round(last * k / (TRAIN_CHUNKS - 1)) for k in range(TRAIN_CHUNKS)})
            out.append(b"".join(text[a : a + CHUNK].ljust(CHUNK, b"\0") for a in at))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "label", "chunks"])


def train_filters(chunks: list[bytes], y: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Filters and their biases, by Adam on the log loss of a temporary head over mean and maximum."""
    rng = np.random.default_rng(seed)
    p = {"f": rng.normal(0, 0.25, (WIDTH, 256, FILTERS)), "b": np.zeros(FILTERS), "v": rng.normal(0, 0.3, 2 * FILTERS), "c": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    if not len(y) or y.min() == y.max():
        return p["f"], p["b"]
    # Both classes weigh alike, or the rare one would hardly move the filters.
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            count = np.array([len(chunks[i]) // CHUNK for i in pick])
            first = np.concatenate(([0], np.cumsum(count)))
            data = np.frombuffer(b"".join(chunks[i] for i in pick), np.uint8)
            conv = _convolve(data, p["f"]).reshape(first[-1], CHUNK // STEP, FILTERS)
            # The last place of a chunk would look into the next one.
            conv[:, -((WIDTH - STEP) // STEP) :] = -9
            at = conv.argmax(1)
            top = np.take_along_axis(conv, at[:, None], 1)[:, 0] + p["b"]
            pooled = np.maximum(top, 0)
            mean, most = np.add.reduceat(pooled, first[:-1]) / count[:, None], np.maximum.reduceat(pooled, first[:-1])
            x = np.concatenate((mean, most), 1)
            z = x @ p["v"] + p["c"]
            d = ((1 / (1 + np.exp(-z)) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            g = {"v": x.T @ d, "c": d.sum(keepdims=True)}
            owner = np.repeat(np.arange(len(pick)), count)
            down = (d[:, None] * p["v"][:FILTERS] / count[:, None])[owner] + (d[:, None] * p["v"][FILTERS:])[owner] * (pooled == most[owner])
            down *= top > 0
            g["b"] = down.sum(0)
            g["f"] = np.zeros_like(p["f"])
            row, col = np.nonzero(down)
            start = row * CHUNK + at[row, col] * STEP
            for j in range(WIDTH):
                np.add.at(g["f"][j], (data[np.minimum(start + j, len(data) - 1)], col), down[row, col])
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return p["f"], p["b"]


def _featured(shared):
    def of(batches):
        filters, bias = shared.value
        for batch in batches:
            x = features(_encoded(batch.column(2)), filters, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "label", "x"])

    return of


def _scored(shared):
    def of(batches):
        filters, bias, head = shared.value
        for batch in batches:
            x = features(_encoded(batch.column(1)), filters, bias)
            z = x.astype(float) @ head[:-1] + head[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return of


def score_quality(docs: DataFrame, labels: DataFrame, most: int = LABELLED, threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, quality, ...) -> (doc_id, held_out, score, predicted)."""
    context = docs.sparkSession.sparkContext
    rows = labelled_sample(docs, labels, "quality", most).select("doc_id", "label", "text")
    got = rows.mapInArrow(_examples, "doc_id long, label int, chunks binary").toPandas().sort_values(["doc_id", "chunks"], kind="stable")
    filters, bias = train_filters([bytes(c) for c in got["chunks"]], got["label"].to_numpy(np.float32))
    whole = rows.mapInArrow(_featured(context.broadcast((filters, bias))), "doc_id long, label int, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(whole["x"].tolist(), float).reshape(len(whole), 2 * FILTERS)
    head = fit_logistic(x, whole["label"].to_numpy(float), np.zeros(2 * FILTERS + 1), strength=0.1)
    scored = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_scored(context.broadcast((filters, bias, head))), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
