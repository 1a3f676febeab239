"""Main text of pages written by hand, not by the generator that the weights are learned on."""

import pytest

from stallwise.llm import main_text

P = "The harbour town had for long been known for its <a href=/x>salt</a> trade and its <a href=/y>old mills</a> near the <a href=/z>river bank</a>, which burned down twice."
PLAIN = "The harbour town had for long been known for its salt trade and its old mills near the river bank, which burned down twice."
LONG = "Salt was traded here for many hundred years by people of the town."


def site(body):
    return f"<html><head><title>Town</title></head><body><header><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav></header>{body}<footer><p>Copyright 2020, all rights reserved</p></footer></body></html>"


PAGES = {
    "linked paragraphs": ("<div id='content'>" + f"<p>{P}</p>" * 6 + "</div>", " ".join([PLAIN] * 6)),
    "list of links in an article": (
        "<article><h1>Salt</h1><p>Salt was traded here.</p><p>It made the town rich for many years.</p><ul><li><a href=/a>Salt roads</a></li><li><a href=/b>Mills of the river</a></li></ul></article>",
        "Salt Salt was traded here. It made the town rich for many years. Salt roads Mills of the river",
    ),
    "see also": (f"<main><h1>Salt</h1><p>{LONG}</p><h2>See also</h2><ul><li><a href=/a>Salt roads</a></li><li><a href=/b>Mills</a></li></ul></main>", f"Salt {LONG} See also Salt roads Mills"),
    "a chapter named Comments": (
        f"<article><h1>Salt</h1><h2>History</h2><p>{LONG}</p><h2>Comments</h2><p>Many writers of the time commented on the trade and on its taxes.</p></article>",
        f"Salt History {LONG} Comments Many writers of the time commented on the trade and on its taxes.",
    ),
    "first heading of the first section": (f"<article><section><h2>Early years</h2><p>{LONG}</p></section><section><h2>Later</h2><p>{PLAIN}</p></section></article>", f"Early years {LONG} Later {PLAIN}"),
    "comments of readers": (
        f"<article><h1>Salt</h1><p>{LONG}</p></article><div id='comments'><h3>2 comments</h3><div class='comment'><p>Nice piece, thank you!</p></div><div class='comment'><p>I do not agree with this.</p></div></div>",
        f"Salt {LONG}",
    ),
    "advert and newsletter in the article": (
        f"<article><h1>Salt</h1><p>{LONG}</p><div class='ad'>Advertisement buy two for one today</div><p>{PLAIN}</p><div class='newsletter'><p>Sign up for our weekly letter</p></div></article>",
        f"Salt {LONG} {PLAIN}",
    ),
}


@pytest.fixture(scope="module")
def weights():
    return main_text.learn()


@pytest.mark.parametrize("name", PAGES)
def test_whole_article_and_nothing_else(weights, name):
    body, want = PAGES[name]
    assert main_text.extract(site(body), weights) == want


def test_repeated_empty_and_very_long_pages(spark, weights):
    long = site("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")
    rows = [(1, "u", site(f"<article><p>{LONG}</p></article>")), (1, "u", site(f"<article><p>{LONG}</p></article>")), (2, None, None), (3, "", ""), (4, "v", long)]
    got = sorted(tuple(r) for r in main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), weights).select("page_id", "n_chars").collect())
    assert got == [(1, len(LONG)), (1, len(LONG)), (2, 0), (3, 0), (4, 20_000 * (len(LONG) + 1) - 1)]
