"""URL filters: rules of a host and a path prefix, found by digests of the expressions that a URL expands into.

A URL is expanded into every pair of a host suffix (at label borders) and a path prefix that a rule could have. An
expression's short hash prefix is joined with the rules'; the full digest then confirms it, and
of a URL's rules the longest wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the hash prefix that is joined on.
PREFIX_DIGITS = 8
#: Rule sets up to this many rows are broadcast (about 150 bytes each); larger ones are joined by a shuffle.
MOST_BROADCAST = 200_000
#: In a shuffle an expression with more than this share of all expressions is joined by itself; there are fewer than 1,000 of them.
HOT_SHARE = 1000
DEFAULT = "allow"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed values: (host, path, verdict), in order.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a URL without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def hashed_rules(rules: DataFrame) -> DataFrame:
    """One row for each distinct host and path, with its digest and rank; of equal rules a block wins."""
    host = F.translate("host", UPPER, UPPER.lower())
    # Other rules fit no URL: a host has no slash, and a path is empty or starts with one.
    able = rules.where("verdict IS NOT NULL AND host NOT LIKE '%/%' AND (path = '' OR path LIKE '/%')")
    distinct = able.groupBy(host.alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("rule_verdict"))
    rule = F.concat("rule_host", "rule_path")
    out = distinct.withColumns({"rule": rule, "rule_digest": F.sha2(rule, 256)})
    # Longest first; of equal length the one with the longer host.
    rank = F.struct(F.length("rule").alias("length"), F.length("rule_host").alias("host_length"), F.col("rule"), F.col("rule_verdict").alias("verdict"))
    return out.select(F.substring("rule_digest", 1, PREFIX_DIGITS).alias("rule_prefix"), "rule_digest", rank.alias("rank"))


def _lengths(rules: DataFrame) -> tuple[list[int], list[int], list[int]]:
    """Lengths that rules' hosts have, those of paths that end with a slash, and those of other paths.

    A URL need only be expanded at these; there are no more of them than the longest rule has characters.
    """
    slash = F.endswith("path", F.lit("/"))
    got = rules.agg(F.array_sort(F.collect_set(F.length("host"))), F.array_sort(F.collect_set(F.when(slash, F.length("path")))), F.array_sort(F.collect_set(F.when(~slash, F.length("path"))))).first()
    return tuple(list(x or []) for x in got)


def expressions(host: Column, path: Column, lengths: tuple[list[int], list[int], list[int]]) -> Column:
    """All host suffixes with all path prefixes, joined, as an array."""
    hosts, folders, others = (F.array(*map(F.lit, x)).cast("array<int>") for x in lengths)
    n = F.length(host)
    suffixes = F.filter(hosts, lambda k: (k == n) | (k < n) & (F.substring(host, n - k, F.lit(1)) == "."))
    prefixes = F.concat(F.filter(folders, lambda k: (k <= F.length(path)) & (F.substring(path, k, F.lit(1)) == "/")), F.filter(others, lambda k: k <= F.length(path)))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(F.substr(host, n - h + 1), F.substr(path, F.lit(1), p)))))


def _confirmed(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows joined with rules on the hash prefix, kept where the digests agree."""
    return rows.join(rules, F.col("_prefix") == F.col("rule_prefix")).where("_digest = rule_digest")


def matched(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows: (_row, _digest) -> (_row, rank) of every rule that fits, for rule sets of any size.

    Both are dealt by hash prefix, but for expressions that very many rows share (``com/``): each of these meets
    the rules once, and the few results go to the rows.
    """
    rows = rows.withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))
    counts = rows.groupBy("_prefix", "_digest").agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = counts.where(F.col("_n") * HOT_SHARE > total).select("_prefix", "_digest")
    hits = _confirmed(hot, rules).select(F.col("_digest").alias("hot_digest"), "rank")
    cold = rows.join(F.broadcast(hot.select(F.col("_digest").alias("hot_digest"))), F.col("_digest") == F.col("hot_digest"), "left_anti")
    warm = rows.join(F.broadcast(hits), F.col("_digest") == F.col("hot_digest")).select("_row", "rank")
    return _confirmed(cold, rules.hint("shuffle_hash")).select("_row", "rank").union(warm)


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(page_id, url) with host, path, rule and verdict of every page; ``rule`` is null and the verdict ``default`` where no rule fits.

    A rule fits its host and all its subdomains where the path starts with the rule's; the longest (host and path) wins,
    of equal ones that with the longer host, of the same rule given twice a block. Null and malformed URLs have empty
    host and path, which no rule with a host fits. Repeated and null page ids are judged row by row. An empty
    table gives no rows; columns besides page_id and url are ignored.
    """
    rules = rules_frame(pages.sparkSession) if rules is None else rules
    hashed = hashed_rules(rules)
    host, path = host_and_path(F.col("url"))
    # A row's own key; the table is read alike each time, so it is the same in both uses below.
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_row"))
    small = hashed.limit(most_broadcast + 1).count() <= most_broadcast
    expanded = rows.withColumn("_expressions", expressions(F.col("host"), F.col("path"), _lengths(rules)))
    if small:
        # Rules stay with the rows, so that a page's best is found by a partial aggregate where it was read.
        one = expanded.select("page_id", "url", "host", "path", "_row", F.explode_outer("_expressions").alias("_e")).withColumn("_digest", F.sha2("_e", 256)).withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))
        joined = one.join(F.broadcast(hashed), F.col("_prefix") == F.col("rule_prefix"), "left").withColumn("rank", F.when(F.col("_digest") == F.col("rule_digest"), F.col("rank")))
        best = joined.groupBy("_row", "page_id", "url", "host", "path").agg(F.max("rank").alias("rank"))
    else:
        one = expanded.select("_row", F.explode("_expressions").alias("_e")).select("_row", F.sha2("_e", 256).alias("_digest"))
        found = matched(one, hashed).groupBy("_row").agg(F.max("rank").alias("rank"))
        best = rows.join(found, "_row", "left")
    return best.select("page_id", "url", "host", "path", F.col("rank.rule").alias("rule"), F.coalesce("rank.verdict", F.lit(default)).alias("verdict"))
