"""Secret scan: a character convolutional network over every candidate and its surroundings.

Base spans follow exact formats (assign, access, hex) and are always reported. Generators propose
further candidates: long mixed tokens, credentials inside addresses, private key blocks. Windows of WINDOW
characters, STEP apart, cover each candidate whole with BEFORE characters before it and AFTER behind it, and
go through the network: filters over WIDTH characters, rectified, max-pooled once over the candidate and once
over its surroundings, and a logistic layer. A candidate's score is that of its best window. A kind's
threshold keeps RECALL of held-out labelled findings; selected spans stay unless base spans or an earlier one
hold them whole.

Labelled findings are made of every document: known key formats, placeholders and look-alikes written into
its context; its own base findings without the words that give them away, in their own place; and, as
look-alikes, the candidates in its e-mail addresses. Other candidates aren't taken as labels. Each is
learned window by window, equal windows once; a window of a long candidate counts as a secret where it shows most of one.
Windows are dealt over tasks that grow with them. In each of EPOCHS rounds every task learns from all of its own,
starting at the common network, and their networks are averaged. Thresholds come from counts of all held-out windows by
score.

Whole texts are searched; positions are code points. Null and empty texts have no spans. Rows without a
doc_id are left out, repeated rows are searched each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .pii import base_spans as pii_spans
from .pii import joined

#: Findings made in each document, and in all of them at least; windows that one task learns from, about.
MADE_EACH, MADE, TASK_WINDOWS = 2, 4000, 16_000
#: Scores are counted in steps of this in log-odds.
SCORE_STEP = 0.001
#: Parts of a network that are added up apart, and units of 1 that sums are counted in.
PARTS, FINE = 16, 1 << 24
#: Windows of a candidate that are learned from at most, spread over it; all of them are scored.
SAMPLE_WINDOWS = 8
WINDOW, BEFORE, AFTER, STEP, WIDTH, FILTERS = 112, 32, 32, 40, 5, 24
EPOCHS, BATCH, RATE = 8, 64, 0.01
RECALL = 0.99
KINDS = ("assign", "access", "hex")
EXTRA_KINDS = ("token", "url", "key")
_ALL = KINDS + EXTRA_KINDS

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}+")
# A name before an equals sign is no part of a token.
_TOKEN = re.compile(r"[A-Za-z0-9+/_.-]{16,}+={0,2}")
_URL = re.compile(r"[a-z][a-z0-9+]++://[^\s:/@]++:[^\s/@]{3,}+@")
_KEY = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the exact formats, by start, then by kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    if _DIGIT.search(text):
        out += [("token", *m.span()) for m in _TOKEN.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]
    if "://" in text and "@" in text:
        out += [("url", *m.span()) for m in _URL.finditer(text)]
    if "-----BEGIN" in text:
        out += [("key", *m.span()) for m in _KEY.finditer(text)]
    return out


def _starts(a: int, b: int) -> list[int]:
    """Where the windows of a candidate begin, BEFORE characters aside; the last one sees AFTER characters behind it."""
    last = max(a, b + AFTER - (WINDOW - BEFORE))
    return [*range(a, last, STEP), last]


def _views(text: str, a: int, b: int, starts: list[int] | None = None) -> list[tuple[bytes, int, int]]:
    """A candidate's windows as bytes, one for each character, and where the candidate stands in them."""
    out = []
    for p in _starts(a, b) if starts is None else starts:
        s = text[max(0, p - BEFORE) : p].rjust(BEFORE) + text[p : p + WINDOW - BEFORE]
        out.append((s.encode("latin-1", "replace").ljust(WINDOW), max(0, a - p + BEFORE), min(WINDOW, b - p + BEFORE)))
    return out


def _lessons(text: str, kind: str, a: int, b: int, secrets: list[tuple[int, int]]):
    """Labelled windows of a candidate: (window, kind, start, end, label). One that shows less than 16 characters of a secret, and not all of it, is left out."""
    starts = _starts(a, b)
    if len(starts) > SAMPLE_WINDOWS:
        starts = [starts[k * (len(starts) - 1) // (SAMPLE_WINDOWS - 1)] for k in range(SAMPLE_WINDOWS)]
    for p, (view, lo, hi) in zip(starts, _views(text, a, b, starts)):
        shown = [(min(y, p - BEFORE + hi) - max(x, p - BEFORE + lo), min(y, b) - max(x, a)) for x, y in secrets]
        label = any(n >= min(16, whole) > 0 for n, whole in shown)
        if label or all(n <= 0 for n, _ in shown):
            yield view, kind, lo, hi, int(label)


def _places(spans: list[tuple[int, int]]) -> np.ndarray:
    """Which places of a window see the candidate's characters only."""
    k = np.arange(WINDOW - WIDTH + 1)
    at = np.array(spans)
    return (k >= at[:, :1]) & (k + WIDTH <= np.maximum(at[:, 1:], at[:, :1] + WIDTH))


class CharNetwork:
    def __init__(self, seed: int = 9):
        r = np.random.default_rng(seed)
        self.p = {"f": r.normal(0, 0.25, (WIDTH, 256, FILTERS)), "b": np.zeros(FILTERS), "v": r.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _forward(self, data: np.ndarray, inside: np.ndarray):
        n = WINDOW - WIDTH + 1
        conv = self.p["f"][0][data[:, :n]]
        for j in range(1, WIDTH):
            conv += self.p["f"][j][data[:, j : j + n]]
        pooled, place = [], []
        for mask in (inside, ~inside):
            z = np.where(mask[:, :, None], conv, np.float32(-9))
            at = z.argmax(1)
            place.append(at)
            pooled.append(np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + self.p["b"], 0))
        x = np.concatenate(pooled, 1)
        return x, place, x @ self.p["v"] + self.p["c"]

    def score(self, views) -> np.ndarray:
        out = []
        for k in range(0, len(views), 512):
            part = views[k : k + 512]
            data = np.frombuffer(b"".join(v[0] for v in part), np.uint8).reshape(len(part), WINDOW)
            out.append(1 / (1 + np.exp(-np.clip(self._forward(data, _places([v[1:] for v in part]))[2].astype(float), -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)

    def fit(self, views, y: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> CharNetwork:
        r = np.random.default_rng(seed)
        data = np.frombuffer(b"".join(v[0] for v in views), np.uint8).reshape(len(views), WINDOW)
        inside = _places([v[1:] for v in views])
        m, s, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                x, place, z = self._forward(data[pick], inside[pick])
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)).astype(np.float32)
                down = d[:, None] * self.p["v"] * (x > 0)
                g = {"v": x.T @ d, "c": d.sum(keepdims=True), "b": down[:, :FILTERS].sum(0) + down[:, FILTERS:].sum(0), "f": np.zeros_like(self.p["f"])}
                for half, at in enumerate(place):
                    part = down[:, half * FILTERS : (half + 1) * FILTERS]
                    row, col = np.nonzero(part)
                    for j in range(WIDTH):
                        np.add.at(g["f"][j], (data[pick][row, at[row, col] + j], col), part[row, col])
                t += 1
                for name in self.p:
                    m[name] = 0.9 * m[name] + 0.1 * g[name]
                    s[name] = 0.99 * s[name] + 0.01 * g[name] ** 2
                    self.p[name] = (self.p[name] - RATE * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self


def _made(contexts: list[str], n: int, seed: int = 17):
    """Key formats (label 1), placeholders and look-alikes (label 0), written into contexts: (text, kind, start, end, where secrets stand)."""
    r = random.Random(seed)
    pick = lambda a, k: "".join(r.choice(a) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, r.randint(3, 9))
    b64 = lambda k: base64.b64encode(r.randbytes(k)).decode()
    good = [
        lambda: ("token", "ghp_" + pick(low + up + dig, 36)),
        lambda: ("token", "sk_live_" + pick(low + up + dig, 24)),
        lambda: ("token", f"xoxb-{pick(dig, 12)}-{pick(low + up + dig, 24)}"),
        lambda: ("token", "AIza" + pick(low + up + dig + "-_", 35)),
        lambda: ("token", f"eyJ{b64(18)}.{b64(30)}.{b64(24)}".replace("=", "")),
        lambda: ("token", b64(r.randint(20, 48))),
        lambda: ("token", pick(low + up + dig, r.randint(24, 48))),
        lambda: ("url", f"{r.choice(['postgres', 'mysql', 'https', 'redis'])}://{word()}:{pick(low + up + dig + '!$', r.randint(8, 20))}@"),
        lambda: ("key", f"-----BEGIN {r.choice(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n{b64(96)}"),
        lambda: ("token", pick("0123456789abcdef", r.choice([32, 40, 64]))),
    ]
    bad = [
        lambda: ("token", "-".join(word() for _ in range(4)) + pick(dig, 2)),
        lambda: ("token", "/".join(word() for _ in range(4)) + f"/{pick(dig, 2)}.html"),
        lambda: ("token", f"{pick('0123456789abcdef', 8)}-{pick('0123456789abcdef', 4)}-4{pick('0123456789abcdef', 3)}-a{pick('0123456789abcdef', 3)}-{pick('0123456789abcdef', 12)}"),
        lambda: ("token", f"{word()}.{word()}.{pick(dig, 2)}.example.com"),
        lambda: ("token", f"your_{word()}_key_here_{pick('x1', 8)}1"),
        lambda: ("token", pick(r.choice("ax0"), 12) + pick(r.choice("x01"), 8) + "1"),
        lambda: ("token", word() + word() + word() + word() + pick(dig, 1)),
        lambda: ("token", f"20{pick(dig, 2)}-0{pick('123456789', 1)}-{pick('12', 1)}{pick(dig, 1)}T{pick(dig, 2)}.{pick(dig, 3)}Z"),
        lambda: ("token", "=" * r.randint(16, 30) + pick(dig, 1) + word()),
        lambda: ("url", f"https://{word()}:{r.choice(['password', 'PASSWORD', 'xxxx', '****', 'pass'])}@"),
        lambda: ("token", f"{word()}_{word()}_{word()}_v{pick(dig, 1)}.{pick(dig, 1)}.{pick(dig, 2)}"),
    ]
    cues = ["key = ", "Authorization: Bearer ", "auth ", "credential: ", "export KEY=", "", "", ""]
    for k in range(n):
        label = k % 2
        kind, s = r.choice(good if label else bad)()
        # Some stand at the end, or in the middle, of a long path.
        path = lambda: "/".join(word() for _ in range(r.randint(4, 24))) + "/"
        lead, tail = (path(), r.choice(["", "/" + path()])) if kind == "token" and r.random() < 0.2 else ("", "")
        context = r.choice(contexts) if contexts else ""
        cut = r.randint(0, len(context))
        before = context[max(0, cut - 40) : cut] + " " + (r.choice(cues) if label else r.choice(["", "", "see ", "id "]))
        at = len(before) + len(lead)
        yield before + lead + s + tail + " " + context[cut : cut + 60], kind, len(before), at + len(s) + len(tail), [(at, at + len(s))] * label


def _labelled(made: int):
    """Documents -> windows of labelled candidates. ``made``: findings written into each document's context."""

    def of(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(2))):
                text = text or ""
                middle = len(text) // 2
                context = text[max(0, middle - 60) : middle + 60]
                out += [lesson for m in _made([context], made, zlib.crc32(f"{doc_id} {text}".encode("utf-8", "replace"))) for lesson in _lessons(*m)]
                for kind, a, b in base_spans(text):
                    # The value alone, where the whole assignment stood.
                    value = _ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
                    if len(value) >= 16:
                        before = text[max(0, a - BEFORE) : a]
                        out += _lessons(before + value + text[b : b + WINDOW], "token", len(before), len(before) + len(value), [(len(before), len(before) + len(value))])
                mails = np.array([(a, b) for kind, a, b in pii_spans(text) if kind == "email"] if "@" in text else []).reshape(-1, 2)
                for kind, a, b in candidates(text) if len(mails) else ():
                    # Addresses don't overlap, so the first that ends behind a candidate's start is the only one to look at.
                    k = int(np.searchsorted(mails[:, 1], a, "right"))
                    if k < len(mails) and mails[k, 0] < b:
                        out += _lessons(text, kind, a, b, [])
            columns = list(zip(*out)) or [[]] * 5
            types = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["window", "kind", "a", "b", "label"])

    return of


def _whole(batches) -> list[tuple]:
    """A task's lessons, in an order that doesn't depend on how they came."""
    return sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))


def _round(network: CharNetwork, seed: int):
    """A task's lessons -> the network that it learned from them, starting at a common one, times their number: in PARTS parts, in units of 1 / FINE."""

    def of(batches):
        rows = _whole(batches)
        if rows:
            own = CharNetwork()
            own.p = dict(network.p)
            own.fit([(r[0], r[2], r[3]) for r in rows], np.array([r[4] for r in rows], float), seed=seed, epochs=1)
            flat = np.concatenate([own.p[k].ravel() for k in sorted(own.p)]).astype(np.float64)
            yield _parts({k: x for k, x in enumerate(np.array_split(np.rint(flat * len(rows) * FINE).astype(np.int64), PARTS))}, len(rows))

    return of


def _parts(total: dict[int, np.ndarray], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([n] * len(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "n", "total"])


def _added_up(batches):
    """Parts of many tasks' networks -> each part's sum, one row at a time. Whole numbers come to the same in any order."""
    total: dict[int, np.ndarray] = {}
    n: dict[int, int] = {}
    for batch in batches:
        for part, many, raw in zip(*(c.to_pylist() for c in batch.columns)):
            total[part] = total.get(part, 0) + np.frombuffer(raw, np.int64)
            n[part] = n.get(part, 0) + many
    for part, x in total.items():
        yield _parts({part: x}, n[part])


def network_sums(dealt: DataFrame, network: CharNetwork, seed: int) -> DataFrame:
    """(part, n, total): what all tasks learned, added up by part, so that the driver gets one network however many tasks there are."""
    form = "part long, n long, total binary"
    return dealt.mapInArrow(_round(network, seed), form).repartition(PARTS, "part").mapInArrow(_added_up, form)


def _odds(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _binned(network: CharNetwork):
    def of(batches):
        for batch in batches:
            window, kind, a, b, label = (c.to_pylist() for c in batch.columns)
            step = np.floor(_odds(network.score(list(zip(window, a, b)))) / SCORE_STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(label, pa.int64()), pa.array(step)], ["kind", "label", "step"])

    return of


def thresholds(score: np.ndarray, y: np.ndarray, kinds: np.ndarray, n: np.ndarray | None = None) -> dict[str, float]:
    """Of each kind a score that keeps RECALL of its positive findings: halfway, in log-odds, between the highest such score and the next negative finding below it.

    A kind without any positives takes the threshold of all kinds together. n: how many findings each stands for.
    """
    if not y.any():
        raise ValueError("no held-out labelled findings to set thresholds by")
    n = np.ones(len(y)) if n is None else n
    out = {}
    for kind in EXTRA_KINDS:
        mine = kinds == kind
        if not y[mine].any():
            mine = np.ones(len(y), bool)
        order = np.flatnonzero(mine)[np.argsort(-score[mine], kind="stable")]
        hits = np.cumsum(n[order] * y[order])
        most = score[order[np.flatnonzero(hits >= RECALL * hits[-1])[0]]]
        below = score[mine & (y == 0) & (score < most)]
        half = (_odds(most) + (_odds(below.max()) if len(below) else _odds(most) - 2)) / 2
        out[kind] = float(min(most, 1 / (1 + np.exp(-half))))
    return out


def labelled_windows(docs: DataFrame, made_each: int = MADE_EACH) -> DataFrame:
    """(window, kind, a, b, label) of all labelled findings of all documents, equal ones once."""
    return docs.select("doc_id", "text").mapInArrow(_labelled(made_each), "window binary, kind string, a long, b long, label long").distinct()


def learn(docs: DataFrame, made: int = MADE, seed: int = 3):
    """The network and the threshold of each kind, from all documents."""
    network = CharNetwork()
    many = docs.count()
    if not many:
        return network, dict.fromkeys(EXTRA_KINDS, 1.1)
    lessons = cut(labelled_windows(docs, max(MADE_EACH, -(-made // many))))
    held = F.pmod(F.xxhash64("window", F.lit(seed)), F.lit(4)) == 0
    tasks = max(1, -(-lessons.count() // TASK_WINDOWS))
    dealt = cut(lessons.where(~held).repartition(tasks, "window"))
    names, shapes = sorted(network.p), {k: v.shape for k, v in network.p.items()}
    ends = np.cumsum([network.p[k].size for k in names])[:-1]
    for k in range(EPOCHS):
        got = sorted(map(tuple, network_sums(dealt, network, k).collect()))
        mean = np.concatenate([np.frombuffer(r[2], np.int64) for r in got]) / FINE / got[0][1]
        network.p = {name: x.reshape(shapes[name]).astype(np.float32) for name, x in zip(names, np.split(mean, ends))}
    counted = lessons.where(held).mapInArrow(_binned(network), "kind string, label long, step long").groupBy("kind", "label", "step").count().orderBy("kind", "label", "step").collect()
    kinds, label, step, n = (np.array(x) for x in zip(*counted))
    return network, thresholds(1 / (1 + np.exp(-step * SCORE_STEP)), label.astype(float), kinds, n.astype(float))


def find(text: str, model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of one text. Every candidate is scored, base ones too; those stay whatever their score."""
    network, thresholds = model
    base = base_spans(text)
    offered = candidates(text)
    if not offered:
        return base, base
    views = [_views(text, a, b) for _, a, b in base + offered]
    first = np.cumsum([0, *map(len, views)])[:-1]
    scores = np.maximum.reduceat(network.score([v for each in views for v in each]), first)[len(base) :]
    # A candidate that one run of spans holds whole adds nothing; one that reaches beyond them stays whole.
    runs: list[list[int]] = []
    for _, a, b in base:
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    starts = np.array([a for a, _ in runs])
    more: list[tuple[str, int, int]] = []
    last = -1
    for s, (kind, a, b) in sorted(zip(scores.tolist(), offered), key=lambda x: (x[1][1], -x[0])):
        k = int(np.searchsorted(starts, a, "right")) if runs else 0
        if s >= thresholds[kind] and b > last and (k == 0 or runs[k - 1][1] < b):
            more.append((kind, a, b))
            last = b
    return base, sorted(base + more, key=lambda s: (s[1], _ALL.index(s[0])))


def _search(shared):
    def of(batches):
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base, every = find(text, shared.value) if text else ([], [])
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            n = np.array(counts, np.int64).reshape(len(counts), len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[:, k].copy()) for k in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return of


def find_secrets(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_assign, n_access, n_hex, base_sha256, spans); counts are of base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, **options))
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_search(shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[SECRET]"


def redact(text: str, spans) -> str:
    """The text with every run of overlapping spans replaced by MASK."""
    out, last = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= last:
            out += [text[last:a], MASK]
        last = max(last, b)
    return "".join([*out, text[last:]])


def _redacted(shared, at):
    def of(batches):
        for batch in batches:
            texts = [redact(t, find(t, shared.value)[1]) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return of


def redact_secrets(docs: DataFrame, **options) -> DataFrame:
    """Masks every found span in ``text``; ``n_chars``, where there is one, follows. All rows and columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, **options))
    out = docs.mapInArrow(_redacted(shared, docs.columns.index("text")), docs.schema)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out
