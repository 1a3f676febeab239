"""Repeated rows, ties and very long rows: each row counts for itself, equal rows get equal results, nothing is cut."""

import collections

import pytest

from stallwise.llm import main_text, packing, quality, toxicity

SCHEMA = "doc_id long, text string, bin_id long, score string"


@pytest.fixture(scope="module")
def labelled(spark):
    """Clean sentences, rude ones and noise, their labels, and rows that are repeated or share an id."""
    rows, labels = [], []
    for i in range(120):
        good, bad = i % 4 != 0, i % 3 == 0
        t = f"The {i} boats came in before the storm and the harbour was quiet again. " * (3 + i % 5)
        rows.append((i, (t if good else t.upper().replace(" ", "%% ")) + ("You are a stupid idiot, moron. " if bad else ""), i, "x"))
        labels.append((i, int(good), int(bad)))
    again = [rows[1], rows[1], rows[3], (7, "one id and another text", 0, "y"), (500, None, 0, ""), (500, None, 0, ""), (None, "no id at all", 0, "")]
    return spark.createDataFrame(rows + again, SCHEMA), spark.createDataFrame(labels + labels[:20], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_repeated_rows_are_scored_each_and_alike(labelled, score):
    got = [tuple(x) for x in score(*labelled).select("doc_id", "held_out", "score", "predicted").collect()]
    n = collections.Counter(x[0] for x in got)
    assert None not in n and (n[1], n[3], n[7], n[500], n[2]) == (3, 2, 2, 2, 1)
    assert all(len({x for x in got if x[0] == i}) == 1 for i in (1, 3, 500))


def test_packing_of_repeated_rows_and_ties(spark):
    # All lengths are equal, ids and rows repeat, and each piece still has a place of its own.
    rows = [(i % 10, "x" * 999, i, "y") for i in range(100)] + [(3, None, 0, "")] * 2
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), shard=30).collect()
    assert collections.Counter((x.doc_id, x.n_tokens) for x in got) == collections.Counter({(i, 1000): 10 for i in range(10)} | {(3, 1): 2})
    assert len({(x.bin_id, x.slot) for x in got}) == len({(x.bin_id, x.offset) for x in got}) == 102
    bins = collections.defaultdict(int)
    for x in got:
        bins[x.bin_id] += x.n_tokens
    assert all(bins[x.bin_id] == x.used <= x.capacity for x in got)


def test_packing_of_equal_rows_is_the_same_on_every_run(spark):
    df = spark.createDataFrame([(i % 7, "z" * (i % 5 * 700), i, "y") for i in range(80)], SCHEMA)
    once, again = (sorted(map(tuple, packing.pack(df.repartition(k), shard=20).collect())) for k in (1, 5))
    assert once == again


def test_long_and_repeated_pages(spark):
    body = " ".join(f"word{k}" for k in range(150_000))
    page = f"<nav><a href=/>Home</a></nav><article><h1>A long one</h1><p>{body}</p></article><footer>terms of use</footer>"
    deep = "<div>" * 3000 + "<article><p>Deep inside stands one sentence of text.</p></article>" + "</div>" * 3000
    rows = [(1, "u", page), (1, "u", page), (2, "v", deep), (2, "v", None), (None, "w", page)]
    got = main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = sorted((x.page_id, x.text) for x in got)
    assert texts == [(1, "A long one " + body)] * 2 + [(2, ""), (2, "Deep inside stands one sentence of text.")]
    assert all(x.n_chars == len(x.text) for x in got)
