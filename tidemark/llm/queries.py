"""The subpackage's queries, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, hamming_search, html_extract, license_scan, near_dedup, rule_ensemble, rule_ledger, source_mixing, suffix_dedup, token_counts
from .common import table


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default policy over the ledger of all documents."""
    ledger = rule_ledger.build_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rule_ledger.apply_policy(ledger).select("doc_id", *rule_ledger.MEASURES, "base_failed", "kept", "n_lines", "n_upper", "fail_bits", "policy")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every twentieth vector, among all vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming_search.sign_code("embedding").alias("code"))
    return hamming_search.search(rows, rows.where("id % 20 = 0"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 200 bytes take from each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_substrings(docs, with_text=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document under the piece model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs, keep_text=False)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of each page."""
    return html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the byte-level ids of each document, and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_digests(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.score(docs, model).select("doc_id", rule_ensemble.held_out().alias("held_out"), "score", "predicted")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, texts included, repeated towards equal shares of the sources, in shuffled order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return source_mixing.mix(docs).select("doc_id", "source", "text", "copy_no", "n_copies", "mix_key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_exact_topk": op2_exact_topk,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_license_scans": op5_license_scans,
    "op6_html_extraction": op6_html_extraction,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_source_mixing": op10_source_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3) x),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) y WHERE n >= 2),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM rep) z GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM
  (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) q WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_upper > 50 * word_chars THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (fail_bits & 63) = 0 AS kept,
  n_lines, n_upper, fail_bits, 'strict-1' AS policy
FROM b""",
    "op2_exact_topk": f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, e.vec_id AS id,
  list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CASE WHEN (q.embedding[i] > 0) <> (e.embedding[i] > 0) THEN 1 ELSE 0 END)) AS distance
  FROM e q, e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, CAST(distance AS INTEGER) AS distance FROM r WHERE rank <= {hamming_search.K}""",
    "op10_source_mixing": f"""
WITH s AS (SELECT coalesce(source, '') AS source, sum(coalesce(octet_length(encode(text)), 0)) AS n_bytes FROM documents GROUP BY 1),
r AS (SELECT source, CASE WHEN n_bytes > 0 THEN 1.0::DOUBLE * (CAST(sum(n_bytes) OVER () AS DOUBLE) / sum(CASE WHEN n_bytes > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER ()) / n_bytes ELSE 0 END AS rate FROM s),
t AS (SELECT source, rate, CAST(greatest(ceil(rate / 64), 1) AS BIGINT) AS parts FROM r WHERE rate > 0),
p AS (SELECT source, sum(exp(-rate / parts + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate / parts) - lgamma(k + 1) END)) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT source, rate, parts, unnest(range(0, 41 + CAST(ceil(4 * rate / parts) AS BIGINT))) AS k FROM t) ks),
d AS (SELECT row_number() OVER () AS i, doc_id, source, text FROM documents),
u AS (SELECT i, s, (CAST(('0x' || substr(md5('{source_mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || part), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT d.i, d.doc_id, t.source AS s, unnest(range(0, parts)) AS part FROM d JOIN t ON t.source = coalesce(d.source, '')) parts),
n AS (SELECT i, count(*) AS n_copies FROM u JOIN p ON p.source = u.s AND p.cdf < u.u GROUP BY i),
c AS (SELECT doc_id, source, text, CAST(n_copies AS BIGINT) AS n_copies, CAST(unnest(range(0, n_copies)) AS BIGINT) AS copy_no FROM n JOIN d USING (i))
SELECT doc_id, source, text, copy_no, n_copies, md5('{source_mixing.SEED}-order|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(copy_no AS VARCHAR)) AS mix_key FROM c""",
}
