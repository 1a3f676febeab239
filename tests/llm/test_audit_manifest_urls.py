"""Filter audit, Merkle manifest and URL filters against brute force, on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stallwise.llm import filter_audit, merkle, queries, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, tree string, digest string, mask int"
LABELS = "doc_id long, quality int, toxic int, part string"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 7) for r in rows], DOCS)


def some_docs():
    long = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", " \t\n", "ABC def", "pipe | here", long, long, long.upper(), "same same " * 150, "same same " * 150, "é" * 30_000, "$ " + long, long + " $ END"]
    rows = [(i, t, ("en", None, "de", "ü", "fr")[i % 5], ("a", None, "", "b")[i % 4], None if i % 6 == 0 else len(t or "")) for i, t in enumerate(texts)]
    return rows + [(3, "ABC def", "en", "b", 7), (5, long, "en", "b", 5), (5, long, "en", "b", 5), (None, long, None, "a", 1), (None, long, None, "a", 1), (40, "", "en", "a", 0), (41, None, "", "a", None)]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def failures(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, *_ in rows:
        w, t = words(t), t or ""
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        out.append({k for k, v in fails.items() if v})
    return out


def test_audit_equals_filtering_in_every_order(spark):
    rows = some_docs()
    labels = [(3, 1, 1, "q"), (5, 1, 0, "q"), (5, 0, None, "q"), (8, None, 1, "q"), (9, 0, 1, "q"), (None, 1, 1, "q"), (77, 1, 1, "q")]
    good, toxic = {i for i, q, *_ in labels if q == 1}, {i for i, _, x, _ in labels if x == 1}
    want = collections.defaultdict(lambda: [0] * 6)
    shapley = collections.Counter()
    for (i, _, _, source, _), fails in zip(rows, failures(rows)):
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                w = want[source or "", "".join(order), step]
                here = f in fails and not gone
                w[0] += not gone and not here
                w[1] += here
                w[2] += f in fails and gone
                w[3] += fails == {f}
                w[4] += here and i is not None and i in good
                w[5] += here and i is not None and i in toxic
                shapley[source or "", f] += here
                gone |= here
    got = filter_audit.filter_audit(docs_frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 3 * 600 and {r.part for r in got} == {"a", "b", ""}
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def test_audit_of_nothing(spark):
    none = docs_frame(spark, [])
    assert filter_audit.filter_audit(none, spark.createDataFrame([], LABELS)).count() == 0
    one = filter_audit.filter_audit(docs_frame(spark, [(1, None, None, None, None)]), spark.createDataFrame([], LABELS)).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed) for r in one] == [("", 0, 1)] + [("", 0, 0)] * 4


def test_incidence_of_other_filter_sets():
    m = filter_audit.incidence("XY")
    # Columns: XY1, XY2, YX1, YX2; rows: none, X, Y, both.
    assert m["removed"].tolist() == [[0, 0, 0, 0], [1, 0, 0, 1], [0, 1, 1, 0], [1, 0, 1, 0]]
    assert m["kept"].tolist() == [[1, 1, 1, 1], [0, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0]]
    assert m["shapley"][3].tolist() == [1, 1, 1, 1]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    i, text, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def brute_tree(leaves, fanout):
    """Root, and for each leaf its siblings, level by level, as (before, after)."""
    groups, steps, now = [[k] for k in range(len(leaves))], [[] for _ in leaves], list(leaves)
    while len(now) > 1:
        merged, up = [], []
        for a in range(0, len(now), fanout):
            run = now[a : a + fanout]
            for j in range(len(run)):
                for k in groups[a + j]:
                    steps[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            merged.append(sum(groups[a : a + fanout], []))
            up.append(sha("".join(run)))
        groups, now = merged, up
    return now[0], steps


@pytest.mark.parametrize(("fanout", "levels"), [(2, 12), (2, 1), (2, 2), (3, 1), (5, 2)])
def test_manifest_equals_brute_force(spark, fanout, levels):
    rows = [(i, f"text {i}", ("en", "de", None)[(i * i) % 7 % 3], None, i) for i in range(61)] + [(5, "again", "en", "s", 1), (5, "again", "en", "s", 1), (None, None, None, None, None), (7, "only", "zz", "s", None)]
    trees = collections.defaultdict(list)
    for r in rows:
        trees["" if r[2] is None else "=" + r[2]].append(r)
    names = sorted(trees, key=lambda s: s.encode())
    for t in names:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    inner = {t: brute_tree([leaf_of(r) for r in trees[t]], fanout) for t in names}
    root, outer = brute_tree([inner[t][0] for t in names], fanout)
    want = collections.Counter((leaf_of(r), inner[t][0], root, tuple(inner[t][1][k] + outer[names.index(t)])) for t in names for k, r in enumerate(trees[t]))

    df = docs_frame(spark, rows).repartition(5)
    leaves = df.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), merkle.leaf(**{c: F.col(c) for c in merkle.FIELDS}).alias("digest"))
    m = merkle.manifest(leaves, ["doc_id"], ["doc_id"], fanout, levels)
    got = m.withColumn("folded", merkle.fold(F.col("digest"), F.col("before"), F.col("after"))).collect()
    assert collections.Counter((r.digest, r.subroot, r.root, tuple(zip(r.before, r.after))) for r in got) == want
    assert all(r.folded == root for r in got)


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.dataset_manifest(docs_frame(spark, [])).count() == 0
    row = (1, "", None, None, None)
    (r,) = merkle.dataset_manifest(docs_frame(spark, [row])).collect()
    assert (r.leaf, r.subroot, r.root, r.before, r.after, r.claimed) == (leaf_of(row),) * 3 + ([], [], leaf_of(row))


def test_tampered_rows_are_found(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "s", None if i % 5 == 0 else i) for i in range(200)] + [(None, "x", None, None, 3)]
    docs_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op12_merkle(spark, str(tmp_path)).collect():
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.doc_id % 5 != 0
        assert r.verified != tampered


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


URLS = [
    None, "", "no scheme.com/en/", "http://", "https://com", "https://com/", "https://EXAMPLE.com/en/x?y=1#z", "http://www.Example.com/en/", "ftp://a.b.example.com/en/", "http://example.com/EN/", "http://notexample.com/en/", "http://x.net/es/a://b",
    "http://x.net/fr", "http://x.net/fr/?q", "http://x.net?/fr/", "http://x.net#/es/", "http://example.com:80/en/", "http://example.com./en/", "http://é.net/es/ü", "http://Ä.com/" + "a/" * 20_000, "http://" + "a." * 5_000 + "net/es/", "http://x.net/es/", "http://x.net/es/",
    "http://shop.b.org/sale-1", "http://b.org/sal", "http://shop.b.org/", "http://b.org",
]


@pytest.mark.parametrize("most_broadcast", [200_000, 0])
@pytest.mark.parametrize("more", [(), (("b.org", "/sale", "block"), ("shop.b.org", "/", "allow"), ("B.org", "", "block"), ("com", "/", "block"), ("a/b", "/", "block"), ("org", "sale", "block"))])
def test_urls_equal_brute_force(spark, most_broadcast, more):
    urls = URLS + ["http://hot.com/1"] * 300
    pages = spark.createDataFrame([(None if k == 4 else k, u, "r", "h", 0) for k, u in enumerate(urls)], "page_id long, url string, rule string, host string, _row long")
    rules = list(url_filter.RULES + more)
    got = url_filter.judge_urls(pages, url_filter.rules_frame(spark, rules), most_broadcast=most_broadcast).collect()
    plain = [(h.lower(), p, v) for h, p, v in rules]
    want = collections.Counter((u, *brute_verdict(u, plain)) for u in urls)
    assert collections.Counter((r.url, r.host, r.path, r.rule, r.verdict) for r in got) == want
    assert sorted(r.page_id for r in got if r.page_id is not None) == [k for k in range(len(urls)) if k != 4]


@pytest.mark.parametrize("most_broadcast", [200_000, 0])
def test_no_urls_and_no_rules(spark, most_broadcast):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge_urls(pages.limit(0), most_broadcast=most_broadcast).count() == 0
    (r,) = url_filter.judge_urls(pages, url_filter.rules_frame(spark, []), default="block", most_broadcast=most_broadcast).collect()
    assert (r.host, r.path, r.rule, r.verdict) == ("a.com", "/", None, "block")
