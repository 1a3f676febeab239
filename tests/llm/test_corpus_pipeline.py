"""The corpus pipeline on a small folder: every stage's rule held against plain Python, with odd rows of each kind."""

import random

import pytest

import corpus_pipeline
from stallwise.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, mark long"


def prose(r, n):
    return " ".join("".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 8))) for _ in range(n))


def write(spark, folder, rows, items, labels):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    r = random.Random(31)
    rows, labels = [], []
    for i in range(60):
        bad = i % 3 == 0
        rows.append((i, prose(r, 40) + (" you are a stupid idiot, moron. " if bad else " ") + prose(r, 40)))
        labels.append((i, 1, int(bad)))
    item = prose(r, 30)
    shared = prose(r, 25)
    rows += [
        (100, rows[1][1]), (101, rows[2][1] + " tail"), (102, prose(r, 20) + " " + item + " " + prose(r, 20)), (103, None), (104, ""), (None, prose(r, 30)),
        (105, 'note password = "hunter2hunter2" end'), (106, "word " * 120_000), (107, shared), (107, shared), (107, "you are a stupid moron, idiot"), (108, "clean words that stay here"), (108, "clean words that stay here"),
    ]
    folder = write(spark, tmp_path_factory.mktemp("case"), rows, [(0, item), (1, None), (2, "short")], labels + [(None, 1, 1)])
    return folder, rows


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = []
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs, folder)
        if name != "packing":
            assert got.columns == docs.columns
        out.append([tuple(x) for x in got.collect()])
        docs = spark.createDataFrame(got.rdd, got.schema)
    return out


def test_stages_do_what_they_say(spark, case):
    folder, rows = case
    toxic, once, clean, masked, packed = stages(spark, folder)
    key = lambda some: sorted((-1 if x[0] is None else x[0], x[1] or "") for x in some)
    bad = lambda i, t: t is not None and "stupid" in t
    assert key(toxic) == key((i, t) for i, t in rows if not bad(i, t))
    # Exact and near copies go, one row of each doc_id and text stays, rows without words or id stay.
    want = [x for x in key(toxic) if x[0] not in (100, 101)]
    want.remove((107, rows[-5][1]))
    want.remove((108, rows[-1][1]))
    assert key(once) == want
    assert key(clean) == [x for x in want if x[0] != 102]
    texts = {x[0]: x[1] for x in masked}
    assert len(masked) == len(clean) and texts[105] == f"note {secrets.MASK}\" end" and all(x[4] == len(x[1] or "") or x[1] is None for x in masked)
    sizes = {}
    for x in packed:
        sizes.setdefault(x[5], 0)
        sizes[x[5]] += x[8]
    assert sizes == {i: len((t or "").encode()) + 1 for i, t in texts.items()}


def test_run_is_the_stages_in_a_row(spark, case):
    folder, _ = case
    got = [tuple(x) for x in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(stages(spark, folder)[-1], key=repr)


def test_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path, [], [], [])
    assert [len(x) for x in stages(spark, folder)] == [0] * 5
