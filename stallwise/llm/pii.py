"""Personal data: candidate generators, boosted trees on format and context, calibrated thresholds.

Base spans follow exact formats (email, ip, card, phone) and are always reported. High-recall
generators propose further, overlapping spans: disguised addresses, telephone numbers without a plus
sign, numbers with odd separators, account and identity numbers. Boosted trees score
every candidate by its format and its surroundings, which tell how much other personal data stands near; per
kind, the score of the lowest personal candidate at which candidates that weren't learned from reach PRECISION
is the threshold. Of overlapping selected spans one whose check digit is right stays before others, then the best;
none may overlap a base span. A number with a wrong check digit is none of a card, unless a word says that it is.

Labels are made, on a bounded sample of documents. The personal data that base formats find there is written in
another dress in its own place (label 1), cards there get a wrong check digit as well (label 0), and known formats
(label 1) and look-alikes (label 0) are written into the documents' contexts, both with and without words that
usually stand near them. Thresholds are set on kinds of
look-alikes that the trees didn't see as well. What base formats don't know in a real text is never taken as a label.

Whole texts are searched; positions are code points. Null and empty texts have no spans. Rows without a
doc_id are left out, repeated rows are searched each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import BoostedTrees, threshold_for
from .common import sample_below

#: Bound on the documents that labelled candidates are taken from, and on candidates of each.
SAMPLE_DOCS, SAMPLE_EACH = 2000, 6
#: Look-alikes and known formats written for training.
MADE = 3000
PRECISION = 0.98
KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "national_id")
_AROUND = 60

_DIGIT = re.compile(r"[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive, and starting where a run of digits starts: the same leftmost matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GENERATORS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\x20]?(?:\[at\]|\(at\)|\{at\})[\x20]?[A-Za-z0-9-]++(?:[\x20]?(?:\.|\[dot\]|\(dot\))[\x20]?[A-Za-z0-9-]{2,}+)+", re.I | re.A)),
    ("phone", re.compile(r"(?<![0-9A-Za-z.])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{2,4}[\x20./-][0-9]{2,5}(?:[\x20./-][0-9]{2,4})?(?![0-9A-Za-z]|[./-][0-9])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{3,6}){2,4}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.+_-])[0-9]{13,19}+(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[\x20]?[0-9A-Z]{4}){3,7}(?:[\x20]?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("national_id", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
)
#: Words near personal data.
_CUES = {
    "email": "mail email contact write to",
    "phone": "phone tel telephone call fax mobile cell tél telefon teléfono",
    "card": "card visa mastercard credit debit amex karte carte tarjeta",
    "ip": "ip address host server addr",
    "iban": "iban account bank konto compte cuenta",
    "national_id": "ssn social security passport id",
}
_CUE_WORDS = {k: frozenset(v.split()) for k, v in _CUES.items()}
#: Words near numbers that aren't personal data.
_OTHER_CUES = frozenset("order invoice part item serial version build ticket sku isbn ref lot model batch page".split())
#: Usual last parts of addresses.
_LAST_PARTS = frozenset("com org net edu gov info io de fr es it uk eu".split())
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > end and _LOCAL.match(text[a - 1]):
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the exact formats, by kind as listed, then by start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose; spans may overlap."""
    if not _DIGIT.search(text) and "at" + "]" not in text and "at)" not in text and "at}" not in text:
        return []
    return [(kind, *m.span()) for kind, pattern in _GENERATORS for m in pattern.finditer(text) if kind != "phone" or sum("0" <= c <= "9" for c in m[0]) <= 15]


_ALL = KINDS + EXTRA_KINDS


def checked(kind: str, s: str) -> bool:
    """Whether a card's or an account's check digits are right."""
    if kind == "iban":
        s = re.sub(r"[^0-9A-Z]", "", s)
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    digits = re.sub(r"[^0-9]", "", s)
    return kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)


def _is_date(groups: list[str]) -> bool:
    """Whether number groups read as a day, in any usual order."""
    if len(groups) != 3:
        return False
    n = [int(g[:9]) for g in groups]
    for y, m, d in ((0, 1, 2), (2, 1, 0), (2, 0, 1)):
        if len(groups[y]) in (2, 4) and len(groups[m]) <= 2 and len(groups[d]) <= 2 and 1 <= n[m] <= 12 and 1 <= n[d] <= 31 and (len(groups[y]) == 2 or 1800 <= n[y] <= 2200):
            return True
    return False


def _near(base: list[tuple[str, int, int]], a: int, b: int) -> int:
    """Other personal data within _AROUND characters."""
    return sum(x < b + _AROUND and a - _AROUND < y and not (x < b and a < y) for _, x, y in base)


def describe(text: str, kind: str, a: int, b: int, near_base: int = 0) -> list[float]:
    """Format and context features of one candidate."""
    s, before, after = text[a:b], text[max(0, a - _AROUND) : a], text[b : b + _AROUND]
    digits = re.sub(r"[^0-9]", "", s)
    numbers = re.findall(r"[0-9]+", s)
    groups = [len(g) for g in numbers] or [0]
    # Identity numbers never have these parts.
    void = kind == "national_id" and (numbers[0] in ("000", "666") or numbers[0][0] == "9" or numbers[1] == "00" or numbers[2] == "0000")
    seps = {c for c in s if not c.isalnum()}
    words = [w.lower() for w in _WORD.findall(before)][-5:]
    near = lambda x: x[-1:] if x is before else x[:1]
    return [
        *(float(kind == k) for k in _ALL),
        len(s), len(digits), len(groups), max(groups), min(groups), len(seps),
        float("(" in s), float("-" in s), float("." in s), float("/" in s), float(" " in s), float(":" in s),
        float(checked(kind, s)), float(len(set(digits)) <= 2),
        float(all(int(g) < 256 for g in re.findall(r"[0-9]{1,9}", s)[:4])),
        float(digits[:2] in ("19", "20")), float(digits[:1] == "0"),
        float(any(w in _CUE_WORDS[kind] for w in words)), float(any(w in c for w in words for c in _CUE_WORDS.values())),
        float(before.rstrip()[-1:] in (":", "=")), float(near(before).isalnum()), float(near(after).isalnum()),
        float(_is_date(numbers)), float(void), float(kind == "email" and re.split(r"[^a-z0-9]+", s.lower())[-1] in _LAST_PARTS), float(groups == [3, 2, 4]),
        float(near_base), float(any(w in _OTHER_CUES for w in words)),
        float(sum(c.isdigit() for c in before)), float(sum(c.isdigit() for c in after)), float("$" in before[-3:] or "€" in before[-3:]), float("%" in after[:2]),
    ]


def _made(contexts: list[str], n: int, seed: int = 11, strange: bool = False):
    """Known formats (label 1) and look-alikes (label 0), written into contexts: (text, kind, start, end, label, near). strange: only dresses that are kept from the trees."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))
    parts = lambda s, sep: sep.join(s[k : k + 4] for k in range(0, len(s), 4))
    day = lambda sep: r.choice([f"{r.randint(1950, 2039)}{sep}{r.randint(1, 12):02}{sep}{r.randint(1, 28):02}", f"{r.randint(1, 28):02}{sep}{r.randint(1, 12):02}{sep}{r.randint(1950, 2039)}"])

    def card(wrong=False, n=16):
        s = d(n - 1)
        return s + r.choice([c for c in "0123456789" if luhn(s + c) != wrong])

    def account(country, n, wrong=False):
        own = d(n)
        check = 98 - int(own + "".join(str(int(c, 36)) for c in country) + "00") % 97
        return country + f"{1 + check % 97 if wrong else check:02}" + own

    person = lambda: r.choice([word(), f"{word()[0]}.{word()}", f"{word()}.{word()}", f"{word()}_{word()}"])
    identity = lambda: f"{r.randint(1, 665):03}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}"
    # Each kind: dresses that are learned from, and one that isn't.
    good = {
        "email": ([lambda: f"{person()}{r.choice([' [at] ', ' (at) ', '(at)', '[at]'])}{word()}{r.choice(['.', ' [dot] '])}{r.choice(['com', 'org', 'net', 'de'])}"], [lambda: f"{word()}{r.randint(1, 99)} (at) {word()}(dot){r.choice(['io', 'fr'])}"]),
        "phone": ([lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(3)} {d(3)} {d(4)}"], [lambda: f"{d(3)}.{d(3)}.{d(4)}"]),
        "card": ([lambda: parts(card(), r.choice([".", "_"])), card, lambda: card(True)], [lambda: parts(card(), "/")]),
        "ip": ([lambda: ":".join("%x" % r.randrange(65536) for _ in range(8))], [lambda: ":".join("%04x" % r.randrange(65536) for _ in range(8))]),
        "iban": ([lambda: parts(account(r.choice(["DE", "FR", "ES"]), r.randint(11, 26)), r.choice([" ", ""]))], [lambda: account(r.choice(["GB", "IT"]), 20)]),
        "national_id": ([identity], [identity]),
    }
    bad = {
        "email": ([lambda: f"{word()} (at) {word()}.{word()[:2]}"], [lambda: f"{word()} [at] {word()}.{word()}"]),
        "phone": ([identity, lambda: day(r.choice("-./ ")), lambda: f"{d(2)} {d(3)} {d(3)}", lambda: f"{r.randint(1, 9)}{d(1)}.{d(2)}.{d(3)}"], [lambda: day("-"), lambda: f"{d(3)}/{d(3)}/{d(2)}"]),
        "card": ([lambda: parts(card(True), r.choice([".", "_"])), lambda: card(True), lambda: card(True, r.randint(13, 19))], [lambda: parts(d(20), "/"), lambda: "1" + "0" * 12 + d(1)]),
        "ip": ([lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}:{d(2)}"], [lambda: f"{d(1)}:{d(2)}:{d(2)}:{d(2)}:{d(2)}"]),
        "iban": ([lambda: r.choice(["AB", "XK", "PN"]) + d(16), lambda: parts(account(r.choice(["DE", "FR", "ES"]), r.randint(11, 26), True), r.choice([" ", ""]))], [lambda: "QT" + d(16)]),
        "national_id": ([lambda: f"{r.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}", lambda: f"{d(3)}-00-{d(4)}"], [lambda: f"{d(3)}-{d(2)}-0000"]),
    }
    other = lambda: r.choice([f"{word()}@{word()}.com", f"{r.randint(1, 223)}.{d(2)}.{d(2)}.{d(2)}", f"+1 ({d(3)}) 555-{d(4)}"])
    for k in range(n):
        kind = _ALL[k % len(_ALL)]
        label = int(r.random() < 0.5)
        which = r.randrange(len((good if label else bad)[kind][strange]))
        s = (good if label else bad)[kind][strange][which]()
        own = r.choice(sorted(_CUE_WORDS[kind])) + r.choice([": ", " ", " = "])
        away = r.choice(sorted(_OTHER_CUES)) + r.choice([": ", " ", " no "])
        # A word that fits stands near both, more often near what is meant, and always near a wrong check digit that is meant.
        bare = kind == "card" and s.isdigit()
        wrong = bare and not luhn(s)
        x = r.random()
        cue = (own if x < 0.5 or wrong else "") if label else (own if x < 0.15 and not wrong else away if x < 0.45 else "")
        near = int(r.random() < (0.5 if label or wrong else 0.2)) * r.randint(1, 3)
        context = r.choice(contexts) if contexts else ""
        cut = r.randint(0, len(context))
        before = context[max(0, cut - _AROUND) : cut] + " " + (other() + " " if near and r.random() < 0.5 else "") + cue
        # A bare number with a right check digit is a base span, unless digits stand before it.
        if bare and (not wrong or r.random() < 0.3):
            before += d(r.randint(1, 3)) + " "
        yield before + s + " " + context[cut : cut + _AROUND], kind, len(before), len(before) + len(s), label, near


def _dressed(kind: str, s: str) -> list[tuple[str, int]]:
    """Personal data of a base format in a dress that only the generators know, and what no longer is any: (text, label)."""
    if kind == "email":
        return [(s.replace("@", " [at] "), 1)]
    if kind == "phone":
        return [(s.lstrip("+").partition(" ")[2] or s[1:], 1)]
    if kind == "card":
        digits = re.sub(r"[^0-9]", "", s)
        return [(".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), 1), (digits[:-1] + str((int(digits[-1]) + 1) % 10), 0)]
    return []


def _sampled(batches):
    """Documents -> what base formats find, dressed otherwise in its own place, and a context of each document."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            middle = len(text) // 2
            out.append((text[max(0, middle - _AROUND) : middle + _AROUND], "", 0, 0, 0, 0))
            base = base_spans(text)
            for kind, a, b in base[:SAMPLE_EACH]:
                before, after = text[max(0, a - _AROUND) : a], text[b : b + _AROUND]
                for dressed, label in _dressed(kind, text[a:b]):
                    for other, x, y in candidates(before + dressed + after):
                        if other == kind and x < len(before) + len(dressed) and len(before) < y:
                            meant = label or any(w.lower() in _CUE_WORDS[kind] for w in _WORD.findall(before)[-5:])
                            out.append((before + dressed + after, kind, x, y, int(meant), _near(base, a, b)))
        columns = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), *[pa.int64()] * 4))], ["text", "kind", "a", "b", "label", "near"])


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, made: int = MADE, seed: int = 3):
    """Boosted trees and the threshold of each kind."""
    rows = sorted(map(tuple, sample_below(docs.select("doc_id", "text"), "doc_id", sample_docs).select("text").mapInArrow(_sampled, "text string, kind string, a long, b long, label long, near long").collect()))
    contexts = [r[0] for r in rows if not r[1]]
    found = [r for r in rows if r[1]]
    seen = len(found) + made
    found += [*_made(contexts, made), *_made(contexts, made // 2, seed=12, strange=True)]
    x = np.array([describe(*r[:4], r[5]) for r in found])
    y = np.array([r[4] for r in found], float)
    kinds = np.array([r[1] for r in found])
    # Strange dresses are all kept from the trees.
    held = np.random.default_rng(seed).random(len(y)) < 0.3
    held[seen:] = True
    model = BoostedTrees().fit(x[~held], y[~held])
    score = model.score(x)
    return model, {k: threshold_for(score[held & (kinds == k)], y[held & (kinds == k)], precision=PRECISION) for k in _ALL}


def find(text: str, model, thresholds) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    taken = [(a, b) for _, a, b in base]
    offered = [c for c in candidates(text) if not any(a < c[2] and c[1] < b for a, b in taken)] if len(taken) < 50 else _clear(candidates(text), taken)
    more = []
    if offered:
        scores = model.score(np.array([describe(text, *c, _near(base, *c[1:])) for c in offered]))
        chosen = sorted((not checked(c[0], text[c[1] : c[2]]), -s, c) for s, c in zip(scores, offered) if s >= thresholds[c[0]])
        cover: dict[int, None] = {}
        for *_, (kind, a, b) in chosen:
            if not any(p in cover for p in range(a, b)):
                cover.update(dict.fromkeys(range(a, b)))
                more.append((kind, a, b))
    return base, sorted(base + more, key=lambda s: (_ALL.index(s[0]), s[1]))


def _clear(offered, taken):
    """Candidates that touch no base span, by one pass over both in order."""
    taken = sorted(taken)
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate([b for _, b in taken])
    out = []
    for c in offered:
        k = int(np.searchsorted(starts, c[2]))
        if k == 0 or ends[k - 1] <= c[1]:
            out.append(c)
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _search(shared):
    def of(batches):
        model, thresholds = shared.value
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base, every = find(text, model, thresholds) if text else ([], [])
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            n = np.array(counts, np.int64).reshape(len(counts), len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[:, k].copy()) for k in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return of


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); counts are of base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, **options))
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_search(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
