"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .context_mixing import score_texts
from .decontaminate import find_benchmark
from .filter_audit import filter_audit
from .jaccard_join import jaccard_components
from .main_text import main_text
from .merkle import dataset_manifest, fold
from .packing import pack
from .pii import find_pii
from .quality import score_quality
from .secrets import find_secrets
from .toxicity import score_toxicity
from .url_filter import judge_urls
from .vector_dedup import near_vectors


def op1_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark, sf_dir):
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_vector_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


def op9_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


def op10_context_mixing(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle(spark, sf_dir):
    """Every seventh document (by crc32 of its id) is claimed to have one character more than it has."""
    id_text = F.col("doc_id").cast("long").cast("string")
    n = F.col("n_chars").cast("long")
    claimed = F.when(F.crc32(id_text.cast("binary")) % 7 == 0, n + 1).otherwise(n)
    m = dataset_manifest(table(spark, sf_dir, "documents"), {"n_chars": claimed})
    siblings = F.concat_ws("", F.zip_with("before", "after", lambda b, a: F.concat(b, a)))
    m = m.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": fold(F.col("claimed"), F.col("before"), F.col("after"))})
    return m.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_decontaminate": op4_decontaminate,
    "op5_secrets": op5_secrets,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_main_text": op9_main_text,
    "op10_context_mixing": op10_context_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle": op12_merkle,
    "op13_url_filter": op13_url_filter,
}

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(g) AS n FROM w LEFT JOIN sets USING (doc_id) GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sizes s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n
"""

OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT w.doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM w LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, good, toxic FROM f
), letters(x, v) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.v, q.v, r.v, s.v, t.v] AS vs
  FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.v, q.v, r.v, s.v, t.v])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, vs[step] AS v, coalesce(list_sum(vs[1:step - 1]), 0)::INT AS before FROM orders, generate_series(1, 5) AS g(step)
), n AS (
  SELECT part, filter_order, step, v,
         count(*) FILTER (WHERE mask & (before | v) = 0) AS kept, count(*) FILTER (WHERE mask & v <> 0 AND mask & before = 0) AS removed, count(*) FILTER (WHERE mask & v <> 0 AND mask & before <> 0) AS redundant,
         count(*) FILTER (WHERE mask = v) AS unique_fails, count(*) FILTER (WHERE good AND mask & v <> 0 AND mask & before = 0) AS good_lost, count(*) FILTER (WHERE toxic AND mask & v <> 0 AND mask & before = 0) AS toxic_lost
  FROM m, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, v))::BIGINT AS shapley FROM n
"""

OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, source, lang, n_chars, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 0 AS tampered
  FROM documents, crc
), e AS (
  SELECT doc_id, lang, tampered,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS own, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM d
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || own || tail) AS leaf, sha256(head || CASE WHEN tampered THEN more ELSE own END || tail) AS claimed FROM e
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2
), subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), crown AS (
  SELECT 0 AS level, idx, h, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM crown WHERE n > 1 GROUP BY level, idx // 2
), steps AS (
  SELECT p.tree, p.idx, n.level, CASE WHEN (p.idx >> n.level) % 2 = 1 THEN coalesce(s.h, '') ELSE '' END AS before, CASE WHEN (p.idx >> n.level) % 2 = 0 THEN coalesce(s.h, '') ELSE '' END AS after
  FROM placed p JOIN nodes n ON n.tree = p.tree AND n.idx = p.idx >> n.level AND n.n > 1
  LEFT JOIN nodes s ON s.tree = p.tree AND s.level = n.level AND s.idx = xor(p.idx >> n.level, 1)
  UNION ALL
  SELECT p.tree, p.idx, 1000 + c.level, CASE WHEN (r.idx >> c.level) % 2 = 1 THEN coalesce(s.h, '') ELSE '' END, CASE WHEN (r.idx >> c.level) % 2 = 0 THEN coalesce(s.h, '') ELSE '' END
  FROM placed p JOIN subroots r USING (tree) JOIN crown c ON c.idx = r.idx >> c.level AND c.n > 1
  LEFT JOIN crown s ON s.level = c.level AND s.idx = xor(r.idx >> c.level, 1)
), proofs AS (
  SELECT tree, idx, list({'b': before, 'a': after} ORDER BY level) AS steps FROM steps GROUP BY tree, idx
), folded AS (
  SELECT p.*, coalesce(list_reduce(list_prepend(claimed, list_transform(steps, lambda s: s.b || '|' || s.a)), lambda h, s: sha256(replace(s, '|', h))), claimed) AS folded_root, coalesce(array_to_string(list_transform(steps, lambda s: s.b || s.a), ''), '') AS siblings
  FROM placed p LEFT JOIN proofs USING (tree, idx)
)
SELECT f.doc_id, f.leaf, r.h AS subroot, c.h AS root, sha256(siblings) AS proof_sha256, folded_root, folded_root = c.h AS verified
FROM folded f JOIN subroots r USING (tree), crown c WHERE c.n = 1
"""

OP13_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u
), p AS (
  SELECT row_number() OVER () AS k, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM h
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (k)
"""

ORACLE_SQL = {
    "op6_jaccard_join": OP6_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_merkle": OP12_SQL,
    "op13_url_filter": OP13_SQL,
}
