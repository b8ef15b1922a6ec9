"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hmm, merkle, quality, toxicity
from .bpe import encode_digests
from .decontaminate import find_leaks
from .html_extract import main_texts
from .knn import top_k
from .license import scan_licenses
from .line_rules import line_rules
from .runtime import shared_dir, table
from .simhash import near_fingerprints
from .warc import round_trip
from .whiten import whiten


def word_bpe() -> str:
    """Path of the public tokenizer that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.train_and_score(table(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), word_bpe())


def op4_site_style_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return round_trip(pages, shared_dir(spark)).drop("url")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_at", "longest_item")


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_fingerprints(table(spark, sf_dir, "documents"))


def op8_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_hidden_markov_scores": op2_hidden_markov_scores,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_site_style_text": op4_site_style_text,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash_components": op7_simhash_components,
    "op8_voronoi_top_k": op8_voronoi_top_k,
    "op9_quality": op9_quality,
    "op10_license_scan": op10_license_scan,
    "op11_line_rules": op11_line_rules,
    "op12_whitening": op12_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}

OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS hex,
         max(page_id) OVER (PARTITION BY h) AS top
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string([
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((CAST('0x' || substr(hex, 1 + 5 * (c // 4), 5) AS BIGINT) >> CAST(15 - 5 * (c % 4) AS INT)) & 31), 1)
         FOR c IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP6_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS n, CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS k FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0
), win AS (
  SELECT n, item, k, i, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT n, item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)
), grams AS (
  SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS t
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), occ AS (
  SELECT r, p, k, n, i, item FROM grams JOIN win USING (k, t)
), runs AS (
  SELECT r, k, p - row_number() OVER (PARTITION BY r, n, p - i ORDER BY p) AS run, n, p - i AS diagonal FROM occ
), longest AS (
  SELECT r, max(size) AS longest_match FROM (SELECT r, count(*) + k - 1 AS size FROM runs GROUP BY r, k, n, diagonal, run) GROUP BY 1
), hit AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM occ) GROUP BY 1
), found AS (
  SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(longest_match, 0) AS longest_match
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r) LEFT JOIN longest USING (r)
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d
), win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), again AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS q FROM win WHERE n > 1) GROUP BY r
), raw AS (
  SELECT r, unnest(string_split(t, chr(10))) AS l FROM d
), dup AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM raw WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r
), lines AS (
  SELECT r, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS words,
         array_to_string(regexp_extract_all(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), ' ') AS l
  FROM raw
), host AS (
  SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source
), freq AS (
  SELECT source, l, count(DISTINCT t) AS docs FROM lines JOIN d USING (r) WHERE l <> '' GROUP BY source, l
), common AS (
  SELECT f.source, f.l FROM freq f JOIN host h ON f.source IS NOT DISTINCT FROM h.source WHERE f.docs > 10 AND f.docs > 0.1 * h.docs
), lost AS (
  SELECT r, sum(words) AS n FROM lines JOIN d USING (r) JOIN common c ON c.l = lines.l AND c.source IS NOT DISTINCT FROM d.source GROUP BY r
), f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_common_words
  FROM d JOIN w USING (r) LEFT JOIN again USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)
), g AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - n_common_words AS rest FROM f
)
SELECT * EXCLUDE (rest), NOT base_failed AND rest >= 50 AND rest >= 0.3 * n_words AS kept FROM g
"""



def tree_sql(kind: str, levels: int) -> str:
    """Levels of trees {kind}0 (tree, i, h), and what leaves {kind}c0 (r, tree, i, seen, proof) lead to, run by run."""
    out = []
    for k in range(levels):
        out.append(f"""{kind}m{k} AS (
  SELECT *, count(*) OVER (PARTITION BY tree) > 1 AS many FROM {kind}{k}
), {kind}{k + 1} AS (
  SELECT tree, i // 8 AS i, CASE WHEN bool_or(many) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {kind}m{k} GROUP BY tree, i // 8
), {kind}c{k + 1} AS (
  SELECT c.r, c.tree, c.i // 8 AS i,
         CASE WHEN bool_or(many) THEN sha256(string_agg(CASE WHEN n.i = c.i THEN c.seen ELSE n.h END, '' ORDER BY n.i)) ELSE any_value(c.seen) END AS seen,
         any_value(c.proof) || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i <> c.i), '') AS proof
  FROM {kind}c{k} c JOIN {kind}m{k} n ON n.tree = c.tree AND n.i // 8 = c.i // 8 GROUP BY c.r, c.tree, c.i
)""")
    return ", ".join(out)


def encoded_sql(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(encoded_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce('=' || lang, '-') AS tree, doc_id, {leaf_sql("text")} AS leaf,
         CASE WHEN {CRC_SQL} % 3 = 0 THEN {leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf_sql("text")} END AS seen
  FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
), l0 AS (
  SELECT tree, i, leaf AS h FROM n
), lc0 AS (
  SELECT r, tree, i, seen, '' AS proof FROM n
), {tree_sql("l", 7)}, s AS (
  SELECT tree AS lang, row_number() OVER (ORDER BY tree) - 1 AS i, h FROM l7
), u0 AS (
  SELECT '' AS tree, i, h FROM s
), uc0 AS (
  SELECT c.r, '' AS tree, s.i, c.seen, c.proof FROM lc7 c JOIN s ON s.lang = c.tree
), {tree_sql("u", 3)}
SELECT d.doc_id, d.leaf, s.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.seen AS folded_root, c.seen = t.h AS verified
FROM d JOIN uc3 c USING (r) JOIN s ON s.lang = d.tree CROSS JOIN u3 t
"""

ORACLE_SQL: dict[str, str] = {
    "op5_warc_round_trip": OP5_SQL,
    "op6_decontaminate": OP6_SQL,
    "op8_voronoi_top_k": OP8_SQL,
    "op11_line_rules": OP11_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
