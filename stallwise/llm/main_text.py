"""Main text of web pages by the maximum-scoring subsequence.

A page is a run of blocks and tags. Each word of a block scores what its block is worth, from 1 for content to
JUNK for menus, headers, footers, sidebars, notices, adverts, forms or comments, and tags score negative; one
linear scan finds the best contiguous region. Inside an article element they cost less. Blocks inside it that are worth nothing are left out of its text,
as is whatever is never shown.

What a block is worth follows from labelled pages: a logistic model sums weights of the block's features, which
are its tags, the names on its path (whole class and id tokens and their parts), whether it stands in the page's
article, how much of the block itself is links, how long it is, and the words of short blocks and of the heading before it.
Names of elements that hold most of a page's words say nothing about its parts and don't count, nor do names
like "no-sidebar" and "has-comments".

Labelled pages are made, not taken from the corpus: templates of many site layouts, with usual and unheard-of
names, each word marked as content or not (LABELLED_PAGES of them).

Character references are decoded; white space inside a block becomes one space; blocks are joined in
page order by one space. Null, empty and textless pages give an empty text. Broken markup (missing ends,
a cut-off tag, an unclosed comment) is read as browsers do, as far as it matters here. Rows without a
page_id are left out, repeated rows are extracted each. Extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LABELLED_PAGES = 600
#: Score of a word that is no content at all.
JUNK = -0.5
#: What is left of the cost of tags and junk inside an article.
INSIDE = 0.05
#: An element with more than this share of a page's words is a wrapper.
WRAPPER = 0.6

# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER_SHOWN = frozenset("script style head title noscript template textarea select option button iframe object svg math canvas audio video datalist".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_RAW = re.compile(r"</(script|style|textarea|title|iframe|noscript)\b[^>]*>?", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<!--(?:.*?(?:-->|--!>)|[\s\S]*\Z)|<[!?][^>]*>?|<(?=/?[a-zA-Z])[^>]*\Z|<(?=/?[a-zA-Z])[^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-z]+")
#: Names that tell what an element hasn't, or has somewhere.
_ABOUT = re.compile(r"(?:no|has|have|is|with|without|hide|show|not|js|can)[-_]")
_SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """Names of an element: whole tokens of its class, id and role, and their parts; 'hidden' if it isn't shown."""
    out = []
    if attributes.strip():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role", "aria-label"):
                for token in value.split():
                    if not _ABOUT.match(token):
                        out += ["c:" + token, *("w:" + part for part in _NAME.findall(token))]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("hidden")
    return tuple(out)


def events(page: str):
    """Tags and texts of a page: ("text", str), ("open", tag, marks), ("close", tag)."""
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            yield "text", page[at:], ()
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ()
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, ()
            continue
        yield "open", tag, _marks(tag, m[3])
        if tag in ("script", "style", "textarea", "title", "iframe", "noscript") and not m[3].rstrip().endswith("/"):
            end = next((e for e in _RAW.finditer(page, at) if e[1].lower() == tag), None)
            at = end.end() if end else n
            yield "close", tag, ()


class Element:
    __slots__ = ("tag", "marks", "parent", "hidden", "words", "links")

    def __init__(self, tag: str, marks: tuple[str, ...], parent: Element | None):
        self.tag, self.marks, self.parent = tag, marks, parent
        self.hidden = tag in _NEVER_SHOWN or "hidden" in marks or parent is not None and parent.hidden
        self.words = self.links = 0


class _Open:
    """Open elements, with the implied ends of paragraphs and list items."""

    def __init__(self):
        self.items = [Element("", (), None)]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def _cut(self, k: int) -> None:
        for i in range(len(self.items) - 1, k - 1, -1):
            self.at[self.items[i].tag].pop()
        del self.items[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def open(self, tag: str, marks: tuple[str, ...]) -> None:
        if tag in ("body", "article", "main") and self.at.get("head"):
            self._cut(self.at["head"][0])
        if tag in _BLOCK and tag != "br":
            stop = _SAME_CLOSES.get(tag)
            for k in reversed(self.blocks):
                name = self.items[k].tag
                if name == "p" or name == tag and stop:
                    self._cut(k)
                    break
                if not stop or name in stop:
                    break
        if tag not in _VOID:
            self.at.setdefault(tag, []).append(len(self.items))
            if tag in _BLOCK:
                self.blocks.append(len(self.items))
            self.items.append(Element(tag, marks, self.items[-1]))

    def close(self, tag: str) -> None:
        if self.at.get(tag):
            self._cut(self.at[tag][-1])


class Block:
    """A run of text between block tags, and the innermost element that holds its first word."""

    __slots__ = ("parts", "element", "words", "links", "heading")

    def __init__(self):
        self.parts, self.element, self.words, self.links, self.heading = [], None, 0, 0, ""

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def parse(page: str) -> tuple[list, Element]:
    """A page's shown blocks and tags in order, and its root; elements know how many words they hold, and how many of them in links."""
    stack, run, block, heading = _Open(), [], Block(), {}
    root = stack.items[0]

    def end():
        nonlocal block
        if block.words:
            run.append(block)
            level = block.element
            while level.parent is not None and level.tag not in _BLOCK:
                level = level.parent
            if level.tag in _HEADINGS:
                heading[id(level.parent)] = block.text().lower()
            else:
                # The last heading before it, beside it or beside what holds it.
                for _ in range(3):
                    if level is None or block.heading:
                        break
                    block.heading = heading.get(id(level.parent), "")
                    level = level.parent
        block = Block()

    for kind, value, marks in events(page):
        top = stack.items[-1]
        if kind == "text":
            if top.hidden:
                continue
            text = html.unescape(value)
            block.parts.append(text)
            n = len(text.split())
            if n:
                linked = bool(stack.at.get("a"))
                if block.element is None:
                    block.element = top
                block.words += n
                block.links += n * linked
                top.words += n
                top.links += n * linked
            continue
        if value in _BLOCK:
            end()
        if kind == "open":
            stack.open(value, marks)
        else:
            stack.close(value)
        if not (top.hidden or stack.items[-1].hidden):
            run.append((value, any(stack.at.get(t) for t in ("article", "main"))))
    end()
    return run, root


#: Elements that say nothing about what they hold.
_PLAIN = frozenset("p div section b i em strong a span br h1 h2 h3 h4 h5 h6 blockquote ul ol li table tbody tr td th figure figcaption pre code sub sup u small q cite abbr mark font".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend".split())


def _sum_up(run: list, root: Element) -> None:
    """Words of an element become those of all it holds."""
    seen, order = set(), []
    for x in run:
        e = x.element if isinstance(x, Block) else None
        while e is not None and id(e) not in seen:
            seen.add(id(e))
            order.append(e)
            e = e.parent
    depth: dict[int, int] = {id(root): 0}
    for e in order:
        path = []
        while id(e) not in depth:
            path.append(e)
            e = e.parent
        for p in reversed(path):
            depth[id(p)] = depth[id(p.parent)] + 1
    for e in sorted(order, key=lambda e: -depth[id(e)]):
        if e.parent is not None:
            e.parent.words += e.words
            e.parent.links += e.links


def _bucket(x: int, *edges: int) -> int:
    return sum(x >= e for e in edges)


def described(run: list, root: Element) -> list[list[str]]:
    """Features of each block of a parsed page."""
    _sum_up(run, root)
    blocks = [x for x in run if isinstance(x, Block)]
    total = max(1, root.words)
    own: dict[int, tuple[frozenset, bool, bool]] = {id(root): (frozenset(), False, False)}

    def path(e: Element) -> tuple[frozenset, bool, bool]:
        """Features of an element's path, whether it leads through an article, and whether nothing named or unusual lies between."""
        up = []
        while id(e) not in own:
            up.append(e)
            e = e.parent
        for e in reversed(up):
            names, inside, plain = own[id(e.parent)]
            main = e.tag in ("article", "main") or "c:main" in e.marks or "c:article" in e.marks
            more = {f"<{e.tag}>"} if e.tag not in ("html", "body", "div", "p", "span", "b", "i", "a", "em", "strong") else set()
            if e.words <= WRAPPER * total or main:
                more.update(m for m in e.marks if m != "hidden")
            usual = not e.marks and e.tag in _PLAIN
            own[id(e)] = (names | more, inside or main, main and not inside or plain and usual)
        return own[id(up[0])] if up else own[id(e)]

    paths = [path(b.element) for b in blocks]
    articles = sum(b.words for b, (_, inside, _) in zip(blocks, paths) if inside)
    out = []
    for b, (names, inside, bare) in zip(blocks, paths):
        holder = b.element
        while holder.parent is not None and holder.tag not in _BLOCK:
            holder = holder.parent
        parent = holder.parent or holder
        share = 0 if articles < 0.2 * total else 1 + inside
        linked = _bucket(10 * b.links // b.words, 1, 3, 6, 9)
        words = b.text().lower().split()
        spoken = [w for w in (w.strip(".,:;!?()[]") for w in words) if len(w) > 3 and w.isalpha()]
        out.append(
            [
                # What stands in an element itself has its names, however much else the element holds.
                *(names | {m for m in holder.marks if m != "hidden"}),
                f"article:{share}",
                f"plain:{bare}",
                f"tag:{holder.tag}",
                f"parent:{parent.tag}",
                f"links:{linked}",
                f"links:{linked}:{share}:{bare}",
                f"long:{_bucket(b.words, 3, 7, 15, 40)}",
                f"page:{_bucket(total, 12, 60, 250)}",
                f"stop:{words[-1][-1] in '.!?…'}",
                *(f"t:{w}" for w in spoken[:12] if len(words) <= 12),
                *(f"h:{w}" for w in (w.strip(".,:;!?()[]") for w in b.heading.split()[:6]) if len(w) > 3),
            ]
        )
    return out


class Weights:
    """odds: what each feature adds to a block's log-odds of being content; tags: what a tag costs."""

    def __init__(self, odds: dict[str, float], constant: float, tags: dict[str, float]):
        self.odds, self.constant, self.tags = odds, constant, tags

    def worth(self, features: list[str]) -> float:
        """The chance that a block is content."""
        z = self.constant + sum(self.odds.get(f, 0.0) for f in features)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def cost(self, tag: str) -> float:
        return self.tags.get(tag, -0.3)


def best_span(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the largest sum, the first of them, as short as it can be; empty if none is above zero."""
    best, span, now, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if now <= 0:
            now, start = 0.0, k
        now += score
        if now > best:
            best, span = now, (start, k + 1)
    return span


def extract(page: str | None, weights: Weights) -> str:
    """The best region's text."""
    if not page:
        return ""
    run, root = parse(page)
    worth = iter([(weights.worth(f), "article:2" in f) for f in described(run, root)])
    scores, keep = [], []
    for x in run:
        if isinstance(x, Block):
            p, inside = next(worth)
            keep.append(p >= 0.5)
            # What is left out inside an article is no reason to end it there.
            scores.append(x.words * (JUNK + (1 - JUNK) * p) if p >= 0.5 else x.words * JUNK * (1 - 2 * p) * (INSIDE if inside else 1))
        else:
            keep.append(False)
            scores.append(weights.cost(x[0]) * (INSIDE if x[1] else 1))
    a, b = best_span(scores)
    return " ".join(x.text() for x, ok in zip(run[a:b], keep[a:b]) if ok)


#: Marks a content word of a labelled page.
_SIGN = "\ue000"


def labelled_page(r: random.Random) -> str:
    """A page of a made-up site; content words carry _SIGN."""
    word = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 9)))
    prose = lambda a, b, sign="": " ".join(sign + word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(a, b))) + r.choice([".", ".", "", "!"])
    unheard = lambda: r.choice([word(), f"{word()}-{word()}", f"{word()}_{r.randint(1, 99)}", f"{word()}{word().title()}"])

    def attr(names: str, strange: float = 0.25) -> str:
        """A usual name, whole or as part of another, or now and then an unheard-of one."""
        name = r.choice(names.split())
        name = unheard() if r.random() < strange else r.choice([name, name, f"{name}-{r.choice(names.split())}", f"{word()}-{name}", f"{name} {unheard()}", f"{name}-{r.randint(1, 9)}"])
        return r.choice(["class", "class", "id"]) + f'="{name}"'

    links = lambda k: "".join(f'<li><a href="/{word()}">{prose(1, 4)}</a></li>' for _ in range(k))
    # Usual names and words of page parts.
    menu = "nav navbar menu navigation breadcrumb breadcrumbs topnav pagination pager"
    nav = lambda: r.choice([f"<nav {attr(menu)}><ul>{links(6)}</ul></nav>", f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>", f"<div {attr(menu)}><ul>{links(5)}</ul></div>", f"<ul {attr(menu)}>{links(4)}</ul>", f"<nav><a href=/>{prose(1, 2)}</a> | <a href=/x>{prose(1, 2)}</a></nav>"])
    heads = lambda words: f"<h{(k := r.randint(2, 4))}>{r.choice(words.split('|'))}</h{k}>" if r.random() < 0.7 else ""
    advert = lambda: f"<div {attr('ad ads advert advertisement adslot dfp banner sponsor sponsored promo promoted')}>{r.choice(['', '', 'Advertisement ', 'Sponsored '])}{prose(4, 25)}</div>"
    junk = [
        advert,
        advert,
        lambda: f"<aside {r.choice(['', attr('sidebar related')])}>{heads('Related|More stories|Popular')}<p>{prose(5, 30)}</p></aside>",
        lambda: f"<div {attr('sidebar widget related recommended share sharing social tags rail')}>{heads('Related articles|Read more|Share|Tags|Popular')}<p>{prose(3, 40)}</p><ul>{links(3)}</ul></div>",
        lambda: f"<div {attr('cookie cookies consent notice alert popup modal newsletter subscribe gdpr signup')}><p>{r.choice(['We use cookies ', 'Subscribe to our newsletter ', 'Accept ', 'Sign up '])}{prose(3, 30)}</p></div>",
        lambda: f"<form {r.choice(['', attr('search login signup form')])}><label>{prose(1, 4)}</label><input name=x>{prose(1, 6)}<button>{prose(1, 2)}</button></form>",
        nav,
    ]

    def comments() -> str:
        tag = r.choice(["div", "section"])
        each = lambda: f"<{(u := r.choice(['div', 'li', 'article']))} {attr('comment reply response post-comment', 0.1)}><p>{r.choice(['', word() + ' says: ', 'Posted by ' + word() + ' '])}{prose(5, 50)}</p>{r.choice(['', '<a href=#>Reply</a>'])}</{u}>"
        return f"<{tag} {attr('comments comment discussion disqus responses replies thread feedback comment-list')}>{heads('Comments|2 comments|Leave a reply|Responses|Discussion')}" + "".join(each() for _ in range(r.randint(1, 6))) + f"</{tag}>"

    if r.random() < 0.06:
        # A page of next to nothing.
        return r.choice(["", "<html><body>"]) + "".join(f"<{(u := r.choice(['p', 'p', 'div']))}>{prose(1, 8, _SIGN)}</{u}>" for _ in range(r.randint(1, 3)))
    part = r.choice(["p", "p", "p", "div class=para", "div"])
    title = f"<h1 {r.choice(['', attr('title headline entry-title', 0.3)])}>{prose(2, 12, _SIGN)}</h1>"
    body = r.choice([title, title, f"<header>{title}</header>", f"<div {attr('article-header entry-header post-header', 0.2)}>{title}</div>"])
    # Some articles are full of links.
    linked = r.random() < 0.3
    chain = lambda: " ".join(f'<a href="/{word()}">{prose(1, 3, _SIGN)}</a> {prose(1, r.choice([2, 6, 12]), _SIGN)}' for _ in range(r.randint(1, 6)))
    for _ in range(r.choice([0, r.randint(1, 14), r.randint(2, 14)])):
        if linked and r.random() < 0.6:
            lead = r.choice(["", prose(1, 12, _SIGN) + " "])
            body += f"<{part}>{lead}{chain()}</{part.split()[0]}>" if r.random() < 0.8 else f"<ul><li>{chain()}</li><li>{chain()}</li></ul>"
            continue
        inline = f"<b>{prose(1, 3, _SIGN)}</b> " if r.random() < 0.3 else f'<a href="/x">{prose(1, 2, _SIGN)}</a> ' if r.random() < 0.2 else ""
        x = r.random()
        named = f" {attr('social-history section body text lead paragraph', 0.5)}" if r.random() < 0.2 else ""
        body += (
            f"<{part}>{inline}{prose(1, 90, _SIGN)}</{part.split()[0]}>" if x < 0.7
            else f"<section{named}><p>{prose(3, 60, _SIGN)}</p></section>" if x < 0.76
            else f"<h{(k := r.randint(2, 4))}>{prose(1, 8, _SIGN)}</h{k}>" if x < 0.85
            else "<ul>" + "".join(f"<li>{prose(2, 20, _SIGN)}</li>" for _ in range(3)) + "</ul>" if x < 0.9
            else f"<table><tr><td>{prose(1, 6, _SIGN)}</td><td>{prose(1, 6, _SIGN)}</td></tr></table>" if x < 0.93
            else f"<blockquote>{prose(8, 40, _SIGN)}</blockquote>"
        )
        if r.random() < 0.1:
            body += r.choice(junk)()
    # What an article ends with: reference lists, code, and sections whose headings other parts of pages have as well.
    if r.random() < 0.25:
        item = lambda: r.choice([f'<a href="/{word()}">{prose(1, 6, _SIGN)}</a>', f'<a href="/{word()}">{prose(1, 4, _SIGN)}</a> {prose(1, 9, _SIGN)}'])
        told = " ".join(_SIGN + w for w in r.choice(["See also", "References", "Sources", "Further reading", "External links", "Notes"]).split())
        kind = r.choice(["ul", "ul", "ol"])
        body += r.choice(["", f"<h{(k := r.randint(2, 4))}>{told}</h{k}>"]) + f"<{kind}>" + "".join(f"<li>{item()}</li>" for _ in range(r.randint(1, 8))) + f"</{kind}>"
    if r.random() < 0.1:
        body += f"<pre>{r.choice(['', '<code>'])}{prose(3, 60, _SIGN)}</pre>"
    if r.random() < 0.15:
        told = " ".join(_SIGN + w for w in r.choice(["Comments", "Discussion", "Related work", "Share of voters", "Responses", "Tags", "Popular culture"]).split())
        body += f"<h2>{told}</h2><p>{prose(5, 60, _SIGN)}</p>"
    late = comments() if r.random() < 0.45 else ""
    if late and r.random() < 0.3:
        body, late = body + late, ""
    holder = r.choice(["article", "article", "article", "main", "div class=content", "div id=main", "div class=post-body", f"div class={unheard()}", f"article class={unheard()}"])
    close = holder.split()[0]
    before = "".join(r.choice(junk)() for _ in range(r.randint(0, 2)))
    after = "".join(r.choice(junk)() for _ in range(r.randint(0, 2))) + late
    head = r.choice([f"<header><p>{prose(1, 8)}</p>{nav()}</header>", nav(), f"<div {attr('header masthead topbar site-header')}>{prose(1, 6)}</div>{nav()}", f"<header {attr('header')}><h2>{prose(1, 3)}</h2></header>"])
    foot = r.choice([f"<footer>{r.choice(['', '© '])}{prose(4, 30)}</footer>", f"<footer><p>{prose(4, 30)}</p><ul>{links(3)}</ul></footer>", f"<div {attr('footer copyright colophon legal site-footer')}>{prose(4, 30)}</div>", ""])
    whole = f"{head}{before}<{holder}>{body}</{close}>{after}{foot}"
    # Wrappers name what a page has somewhere, or hasn't.
    about = lambda: " ".join(r.choice(["no-sidebar", "has-comments", "single", "page", "site", "wrapper", "sidebar-left", "with-ads", "menu-open", unheard()]) for _ in range(r.randint(1, 3)))
    for _ in range(r.choice([0, 0, 1, 2])):
        whole = f'<div {r.choice(["class", "id"])}="{about()}">{whole}</div>'
    return f"<!DOCTYPE html><html><head><title>{prose(2, 10)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body{r.choice(['', f' class={chr(34)}{about()}{chr(34)}'])}>{whole}</body></html>"


def learn(pages: int = LABELLED_PAGES, seed: int = 23, rounds: int = 400, prior: float = 5e-5) -> Weights:
    """Weights from labelled pages: the blocks' features by a logistic model with a Gaussian prior, tags by their log-odds of standing inside content or elsewhere."""
    r = random.Random(seed)
    names: dict[str, int] = {}
    flat, size, label, weight = [], [], [], []
    inside, outside = Counter(), Counter()
    for _ in range(pages):
        run, root = parse(labelled_page(r))
        blocks = [x for x in run if isinstance(x, Block)]
        signed = [_SIGN in b.text() for b in blocks]
        for b in blocks:
            b.parts = ["".join(b.parts).replace(_SIGN, "")]
            b.heading = b.heading.replace(_SIGN, "")
        for b, f, own in zip(blocks, described(run, root), signed):
            flat += [names.setdefault(x, len(names)) for x in f]
            size.append(len(f))
            label.append(own)
            weight.append(1 + math.log(b.words))
        at = [k for k, x in enumerate(run) if isinstance(x, Block)]
        first, last = next((k for k, own in zip(at, signed) if own), 0), max((k for k, own in zip(at, signed) if own), default=0)
        for k, x in enumerate(run):
            if not isinstance(x, Block):
                (inside if first - 1 <= k <= last + 1 else outside)[x[0]] += 1
    flat, size, y, weight = np.array(flat), np.array(size), np.array(label, float), np.array(weight)
    # What was seen on one or two blocks only is left unlearned.
    rare = np.bincount(flat, minlength=len(names)) < 3
    first = np.cumsum(size) - size
    w, constant = np.zeros(len(names)), 0.0
    seen, seen_c = np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.add.reduceat(w[flat], first) + constant
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / weight.sum()
        g = np.bincount(flat, np.repeat(error, size), len(names)) + prior * w
        g[rare] = 0
        seen, seen_c = 0.95 * seen + 0.05 * g**2, 0.95 * seen_c + 0.05 * error.sum() ** 2
        w -= 0.03 * g / np.sqrt(seen)
        constant -= 0.03 * error.sum() / np.sqrt(seen_c)
    tags = {t: -min(4.0, max(0.02, math.log((outside[t] + 1) / (inside[t] + 1)))) for t in inside.keys() | outside.keys()}
    return Weights({f: float(w[k]) for f, k in names.items() if not rare[k]}, float(constant), tags)


def _extracted(shared):
    def of(batches):
        for batch in batches:
            texts = [extract(p, shared.value) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return of


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """pages (page_id, url, html, ...) -> (page_id, url, text, n_chars)."""
    shared = pages.sparkSession.sparkContext.broadcast(weights or learn())
    return pages.where("page_id IS NOT NULL").select("page_id", "url", "html").mapInArrow(_extracted(shared), "page_id long, url string, text string, n_chars long")
