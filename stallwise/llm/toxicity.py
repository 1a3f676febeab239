"""Toxicity by a weighted finite-state pattern grammar.

Each text is cut into clauses, each word becomes a symbol (insult, threat, target, negation, report,
mention and so on, or other), and two cascades of transducers rewrite the symbols. The first reads a clause backwards
and notes at an insult or threat what follows it: a target near it, an object right behind a threat, a reporting
verb, a noun that makes it a mere mention ("is an insult"), or nothing. The second reads forwards: a negation or a
mention close before it, a reporting verb in the clause, a target before or after it, "is a" before an insult that
ends its clause, an order to be silent before it decide the class of the matched pattern. A threat is one
that somebody makes, in the first person or as an order, to its object: "I will hurt you" and not "they hurt you".
Each cascade is composed once into a single table. An insult in no pattern is loose; after an earlier insult of the same text
it belongs to a pile, a pattern too. Loose, negated, reported and mentioned insults and threats without a target
never make a text toxic by themselves: what counts is matched clauses, not isolated words.

The insult lexicon (words, and stems for languages that inflect) and the weights of the patterns are learned from
labelled rows outside the held-out fold: a bounded sample (LABELLED rows) gives each word's log-odds and a
logistic model over the patterns. A short fixed list of common insults counts like a few labelled rows, so that
tiny inputs work too.

Whole texts are scored. Nulls count as empty; an empty text gets the score of a text without matches.
Rows without a doc_id are left out, repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample
from .kernels import LOWER, mix64, pieces, split_words

#: Bound on the labelled rows that are learned from.
LABELLED = 20_000
#: A word, or a stem, is learned if it stands in so many toxic rows and its log-odds, less ERROR standard errors, reach so much.
#: Stems are many more than words, so more of them stand out by chance.
LEAST_ROWS, LEAST_WORD, LEAST_STEM, ERROR = 4, 2.3, 3.0, 1.64
#: Log-odds of the fixed insults until they are learned.
SEED_ODDS = 3.0

# Symbols of the grammar, and what the backward cascade makes of insults and threats.
OTHER, INSULT, THREAT, TARGET, OBJECT, POSSESSIVE, FIRST, COPULA, ARTICLE, ORDER, NEGATION, REPORT, MENTION, END = range(14)
INSULT_AT, INSULT_SAID, INSULT_NAMED, INSULT_LAST, THREAT_AT, THREAT_SAID, SYMBOLS = range(14, 21)
#: Words of the grammar, in four languages.
GRAMMAR = {
    INSULT: "idiot idiots moron morons stupid loser losers pathetic worthless scum trash clown clowns disgusting imbecile vermin dumb bastard asshole idioten dummkopf abschaum connard crétin imbécile ordure estúpido basura imbécil",
    THREAT: "kill hurt destroy beat stab shoot burn töten vernichten schlagen tuer frapper détruire matar golpear destruir",
    TARGET: "they he she these those people du ihr tu ton vous ils tú ti tus usted ustedes ellos",
    OBJECT: "you u yourself yourselves him her them dich dir euch sie te toi",
    POSSESSIVE: "your yours their dein deine votre",
    FIRST: "i we ich wir je nous yo voy vamos",
    COPULA: "is are was were am ist sind bist war est sont es eres son",
    ARTICLE: "a an ein eine einen un une una",
    ORDER: "shut screw piss halt ferme cállate calla",
    NEGATION: "not never no nor isn aren wasn weren don doesn didn nicht kein keine nie ne pas jamais nunca jamás ni",
    REPORT: "said says say called calls quoted quote wrote writes reported claimed alleged sagte sagt nannte schrieb dit disait écrit appelé dijo dice escribió llamó",
    MENTION: "word words term terms insult insults slur slurs expression wort wörter beleidigung mot mots insulte palabra palabras insulto",
}
#: Classes of matched patterns.
LOOSE, PILED, AIMED, NEGATED, REPORTED, MENTIONED, MENACE, IDLE = range(8)
_CLASSES = 8
#: Classes that may make a text toxic.
_PATTERNS = (PILED, AIMED, MENACE)
#: Classes are written as symbols from here on.
_CLASS = 40


class Transducer:
    """A deterministic transducer: ``step(state, symbol) -> (state, symbol)``."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads."""

        def step(state, symbol):
            mine, out = self.step(state[0], symbol)
            theirs, out = other.step(state[1], out)
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)


def _window(opens, rewrites, reach):
    """Within ``reach`` words after a symbol of ``opens``, symbols in ``rewrites`` are rewritten; reach None: to the clause's end."""

    def step(state, symbol):
        if symbol == END:
            return 0, symbol
        if symbol in opens:
            return (reach or 1), symbol
        out = rewrites.get(symbol, symbol) if state else symbol
        return (state if reach is None else max(0, state - 1)), out

    return Transducer(0, step)


def _pile(state, symbol):
    """Insults that no pattern took: the first one of a text is loose, later ones pile up. The state outlives a clause."""
    if symbol == _CLASS + AIMED:
        return 1, symbol
    if symbol == INSULT:
        return 1, _CLASS + (PILED if state else LOOSE)
    return state, _CLASS + IDLE if symbol == THREAT else symbol


def _last(state, symbol):
    """Read backwards: an insult with nothing behind it in its clause."""
    return (1 if symbol == END else 0), INSULT_LAST if state and symbol == INSULT else symbol


def _predicate(state, symbol):
    """Is, a, perhaps one more word, and an insult that ends the clause."""
    if symbol == INSULT_LAST and state >= 2:
        return 0, _CLASS + AIMED
    return {COPULA: 1, ARTICLE: 2 if state == 1 else 0, OTHER: 3 if state == 2 else 0}.get(symbol, 0), symbol


def _menace(state, symbol):
    """A threat to its object, in the first person or as an order that begins the clause; state: (at the start, words since the first person, words since an object)."""
    start, first, near = state
    if symbol == END:
        return (1, 0, 0), symbol
    after = (0, 6 if symbol == FIRST else max(0, first - 1), 3 if symbol == OBJECT else max(0, near - 1))
    if symbol == THREAT_AT:
        return after, _CLASS + (MENACE if start or first else IDLE)
    if symbol == THREAT:
        return after, _CLASS + (MENACE if first and near else IDLE)
    return after, symbol


def lookahead() -> Transducer:
    """For clauses read backwards: end, target, object, report, mention, composed."""
    last = Transducer(1, _last)
    target = _window({TARGET, OBJECT}, {INSULT: INSULT_AT, INSULT_LAST: INSULT_AT}, 5)
    threatened = _window({OBJECT}, {THREAT: THREAT_AT}, 2)
    report = _window({REPORT}, dict.fromkeys((INSULT, INSULT_AT, INSULT_LAST), INSULT_SAID) | {THREAT: THREAT_SAID, THREAT_AT: THREAT_SAID}, None)
    mention = _window({MENTION}, dict.fromkeys((INSULT, INSULT_AT, INSULT_LAST, INSULT_SAID), INSULT_NAMED), 4)
    return last.then(target).then(threatened).then(report).then(mention)


def grammar() -> Transducer:
    """For clauses read forwards: negation, mention, report, target, predicate, order, menace and piles, composed. Output symbols from _CLASS on are classes."""
    insults, threats = (INSULT, INSULT_AT, INSULT_SAID, INSULT_NAMED, INSULT_LAST), (THREAT, THREAT_AT, THREAT_SAID)
    every = lambda which, to: dict.fromkeys(which, _CLASS + to)
    negation = _window({NEGATION}, every(insults + threats, NEGATED), 4)
    mention = _window({MENTION}, every(insults, MENTIONED), 3)
    report = _window({REPORT}, every(insults + threats, REPORTED), None)
    noted = Transducer(0, lambda state, symbol: (0, {INSULT_SAID: _CLASS + REPORTED, THREAT_SAID: _CLASS + REPORTED, INSULT_NAMED: _CLASS + MENTIONED, INSULT_AT: _CLASS + AIMED}.get(symbol, symbol)))
    plain = (INSULT, INSULT_LAST)
    target = _window({TARGET, OBJECT}, every(plain, AIMED), 8)
    owner = _window({POSSESSIVE}, every(plain, AIMED), 1)
    order = _window({ORDER}, every((INSULT_LAST,), AIMED), 3)
    loose = Transducer(0, lambda state, symbol: (0, INSULT if symbol == INSULT_LAST else symbol))
    return negation.then(mention).then(report).then(noted).then(target).then(owner).then(Transducer(0, _predicate)).then(order).then(Transducer((1, 0, 0), _menace)).then(loose).then(Transducer(0, _pile))


def table_of(t: Transducer) -> list[list[tuple[int, int]]]:
    """All reachable states of a composed transducer as a table: [state][symbol] -> (state, symbol written)."""
    # Equal entries are one object, also after they have been sent to a worker, so that a table takes a few megabytes.
    names, out, entries = {t.start: 0}, [], {}
    queue = [t.start]
    while queue:
        row = []
        state = queue.pop(0)
        for symbol in range(SYMBOLS):
            after, wrote = t.step(state, symbol)
            if after not in names:
                names[after] = len(names)
                queue.append(after)
            entry = (names[after], wrote)
            row.append(entries.setdefault(entry, entry))
        out.append(row)
    return out


def matched(symbols: list[int], back: list, forth: list) -> list[tuple[int, int]]:
    """(place, class) of each insult or threat among a text's symbols; END stands between clauses."""
    noted, state = list(symbols), 0
    for k in range(len(symbols) - 1, -1, -1):
        state, noted[k] = back[state][symbols[k]]
    out, state = [], 0
    for k, symbol in enumerate(noted):
        state, wrote = forth[state][symbol]
        if wrote >= _CLASS:
            out.append((k, wrote - _CLASS))
    return out


def _hash(words: list[str]) -> np.ndarray:
    _, run = next(pieces(words))
    return split_words(run, plain=True).hashes


_END_BYTE = np.zeros(256, bool)
_END_BYTE[[ord(c) for c in ".!?;\n"]] = True


#: Bytes of the stems that are learned beside whole words, longest first.
STEMS = (8, 7, 6, 5, 4)


def _stems(words) -> list[np.ndarray]:
    """For each of STEMS the hashes of each word's first bytes; 0 for words that aren't longer."""
    key, out = np.zeros(len(words.starts), np.uint64), {}
    size = words.ends - words.starts
    for j in range(max(STEMS)):
        key = (key << np.uint64(8)) | LOWER[words.buffer[np.minimum(words.starts + j, len(words.buffer) - 1)]]
        if j + 1 in STEMS:
            out[j + 1] = np.where(size > j + 1, mix64(key + np.uint64(j)) | np.uint64(1), np.uint64(0))
    return [out[k] for k in STEMS]


class Lexicon:
    """Hashes of words and stems with their symbol and weight, and the composed cascades."""

    def __init__(self, insults: np.ndarray, weights: np.ndarray):
        fixed = {s: _hash(v.split()) for s, v in GRAMMAR.items() if s != INSULT}
        # Words of the grammar come first: a function word never turns into an insult.
        h = np.concatenate([*fixed.values(), insults])
        symbol = np.concatenate([*(np.full(len(v), s) for s, v in fixed.items()), np.full(len(insults), INSULT)])
        weight = np.concatenate([*(np.full(len(v), 3.0 if s == THREAT else 0.0) for s, v in fixed.items()), weights])
        self.hashes, first = np.unique(h, return_index=True)
        self.symbols, self.weights = symbol[first], weight[first]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.hashes >> np.uint64(44)] = True
        self.back, self.forth = table_of(lookahead()), table_of(grammar())

    def read(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of each word: of the whole word, or of its longest stem that is an insult."""
        symbols, weights = np.zeros(len(words.hashes), np.int64), np.zeros(len(words.hashes))
        for h in (words.hashes, *_stems(words)):
            maybe = np.flatnonzero(self.filter[h >> np.uint64(44)] & (symbols == OTHER))
            if len(maybe) and len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[maybe]
                symbols[maybe[hit]], weights[maybe[hit]] = self.symbols[at[hit]], self.weights[at[hit]]
        return symbols, weights

    def patterns(self, words, symbols, weights, a: int, b: int):
        """Per class the weights of what is matched in words a..b, and the most that one clause holds."""
        known = np.flatnonzero(symbols[a:b])
        ends = np.cumsum(_END_BYTE[words.buffer[words.starts[a] : words.ends[b - 1]]])[words.starts[a:b] - words.starts[a]]
        # Only words near a known one matter; a gap as long as any reach says as much as all its words, one word before or behind all known ones as much as many.
        run, place, last = [], [], None
        for k in known.tolist():
            if last is not None and ends[k] == ends[last]:
                gap = [OTHER] * min(k - last - 1, 9)
            else:
                tail = [OTHER] if last is not None and ends[last + 1] == ends[last] else []
                gap = [*tail, *([END] if last is not None else []), *([OTHER] if k and ends[k - 1] == ends[k] else [])]
            run += [*gap, int(symbols[a + k])]
            place += [*([-1] * len(gap)), k]
            last = k
        if last + 1 < len(ends) and ends[last + 1] == ends[last]:
            run.append(OTHER)
            place.append(-1)
        out, in_clause, best = np.zeros(_CLASSES), {}, 0.0
        for at, got in matched(run, self.back, self.forth):
            w = float(weights[a + place[at]])
            out[got] += w
            if got in _PATTERNS:
                c = int(ends[place[at]])
                in_clause[c] = in_clause.get(c, 0.0) + w
                best = max(best, in_clause[c])
        return out, best


def _count_words(batches):
    """Labelled rows -> (word or stem, toxic rows, other rows), summed per batch."""
    for batch in batches:
        label = np.asarray(batch.column(1)).astype(bool)
        seen: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        stems: list[np.ndarray] = []
        for begin, run in pieces(t.lower() if t else "" for t in batch.column(0).to_pylist()):
            words = split_words(run, plain=True)
            row = np.repeat(np.arange(begin, begin + len(run)), np.diff(words.first)).astype(np.uint64)
            for stem, h in enumerate((words.hashes, *_stems(words))):
                mark = np.unique(np.stack([h, row], 1)[h != 0], axis=0)
                seen.append(mark[:, 0])
                owner.append(label[mark[:, 1].astype(int)])
                stems.append(np.full(len(mark), stem > 0))
        if seen:
            v, first, at = np.unique(np.concatenate(seen), return_index=True, return_inverse=True)
            toxic = np.bincount(at, np.concatenate(owner), len(v)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(v)).astype(np.int64) - toxic), pa.array(np.concatenate(stems)[first])], ["word", "toxic", "other", "stem"])


_FEATURES = ["f_loose", "f_piled", "f_aimed", "f_negated", "f_reported", "f_mentioned", "f_menace", "f_idle", "f_clause"]


def _features(texts, lexicon: Lexicon) -> np.ndarray:
    out = np.zeros((len(texts), len(_FEATURES)))
    for begin, run in pieces(t.lower() if t else "" for t in texts):
        words = split_words(run, plain=True)
        symbols, weights = lexicon.read(words)
        owner = np.searchsorted(words.first, np.flatnonzero((symbols == INSULT) | (symbols == THREAT)), side="right") - 1
        for k in np.unique(owner).tolist():
            sums, best = lexicon.patterns(words, symbols, weights, words.first[k], words.first[k + 1])
            # Amounts count in a damped way: a long text with many matches isn't endlessly more toxic.
            out[begin + k] = [*np.log1p(sums), np.log1p(best)]
    return out


def _rows(shared, extra):
    def of(batches):
        lexicon = shared.value
        for batch in batches:
            x = _features(batch.column(batch.num_columns - 1).to_pylist(), lexicon)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x[:, k].copy()) for k in range(x.shape[1]))], [*extra, *_FEATURES])

    return of


#: Weights that the labelled rows move: of the features above, then the constant.
_PRIOR = np.array([0.1, 1.5, 2.6, 0.1, 0.1, 0.1, 2.6, 0.1, 0.6, -3.0])


def bounded(weights: np.ndarray) -> np.ndarray:
    """Weights within what the grammar means: no match makes a text look cleaner, one aimed insult or menace of weight 3 is enough, and without such a pattern or a pile nothing is."""
    out = np.maximum(weights, 0)
    out[-1] = min(weights[-1], -1.0)
    for k in (AIMED, MENACE):
        out[k] = max(out[k], (0.3 - out[-1]) / np.log(4))
    rest = [LOOSE, NEGATED, REPORTED, MENTIONED, IDLE]
    # Any amount of each, up to a sum of 100, and all of them together stay below one half.
    out[rest] = np.minimum(out[rest], (-0.3 - out[-1]) / np.log(101) / len(rest))
    return out


def fit_patterns(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The weights of the patterns and the constant move with the labels; those of what is no pattern stay at their prior, or a pile's first insult would take the pile's weight."""
    moves = [*_PATTERNS, len(_FEATURES) - 1]
    weights = _PRIOR.copy()
    weights[[*moves, -1]] = fit_logistic(x[:, moves], y, _PRIOR[[*moves, -1]])
    return bounded(weights)


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method for a logistic model with a Gaussian prior around ``prior``; the last weight is the constant."""
    x1 = np.concatenate((x, np.ones((len(x), 1))), 1)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + strength * (w - prior)
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED):
    """Broadcast lexicon and class weights, learned from a bounded sample of labelled rows."""
    rows = labelled_sample(docs, labels, "toxic", most)
    n_toxic, n_all = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    seeds = _hash(GRAMMAR[INSULT].split())
    # What can be learned is bounded with the sample.
    words = rows.select("text", "label").mapInArrow(_count_words, "word long, toxic long, other long, stem boolean").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.first("stem").alias("stem"))
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("other") + 0.5) / F.lit(n_all - n_toxic + 1.0))
    sure = odds - ERROR * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    found = words.where((F.col("toxic") >= LEAST_ROWS) & (sure >= F.when(F.col("stem"), LEAST_STEM).otherwise(LEAST_WORD))).select("word", odds.alias("odds")).orderBy(F.desc("odds"), "word").toPandas()
    learned = found["word"].to_numpy(np.int64).view(np.uint64)
    fresh = seeds[~np.isin(seeds, learned)]
    lexicon = Lexicon(np.concatenate([learned, fresh]), np.concatenate([np.minimum(found["odds"].to_numpy(float), 8.0), np.full(len(fresh), SEED_ODDS)]))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    pdf = rows.select("label", "text").mapInArrow(_rows(shared, ["label"]), "label int, " + ", ".join(f"{c} double" for c in _FEATURES)).toPandas()
    return shared, fit_patterns(pdf[_FEATURES].to_numpy(float), pdf["label"].to_numpy(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, toxic, ...) -> (doc_id, held_out, score, predicted)."""
    shared, weights = learn(docs, labels, most)
    x = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_rows(shared, ["doc_id"]), "doc_id long, " + ", ".join(f"{c} double" for c in _FEATURES))
    z = sum((F.col(c) * float(w) for c, w in zip(_FEATURES, weights)), F.lit(float(weights[-1])))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return x.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _clean(shared, at: int, weights: np.ndarray):
    """Batches without the rows that are rejected; ``at`` is the text's column."""

    def of(batches):
        for batch in batches:
            z = _features(batch.column(at).to_pylist(), shared.value) @ weights[:-1] + weights[-1]
            yield batch.filter(pa.array(z < 0))

    return of


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """Drops the documents that score_toxicity rejects, each row by its own text, without a shuffle; all columns stay. Rows without a doc_id are judged too."""
    shared, weights = learn(docs, labels, most)
    return docs.mapInArrow(_clean(shared, docs.columns.index("text"), weights), docs.schema)
