"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from stocklens.llm import (
    decontaminate,
    fingerprints,
    html_extract,
    language,
    license_scan,
    line_dedup,
    near_dup,
    packing,
    periodic_runs,
    quality,
    secret_scan,
    sharding,
    vector_codes,
)
from stocklens.llm.common import read


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_text(read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", near_dup.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents")).drop("n_confirmed")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_periods(read(spark, sf_dir, "documents"))
    return periodic_runs.summary(periodic_runs.detect(docs))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """k-means of the parts written out round by round, with plain distances to every entry."""

    def near(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (
  SELECT r, p, min_by(e, (far, e)) AS e, min(far) AS far FROM (
    SELECT r, p, e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS far
    FROM c JOIN b{k} b USING (p, d) GROUP BY r, p, e)
  GROUP BY r, p
)"""

    def moved(k: int) -> str:
        return f"""
b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.d, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT p, d, e, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM c JOIN a{k} USING (r, p) GROUP BY p, d, e) m USING (p, d, e)
)"""

    steps = ",".join(f"{near(k)},{moved(k)}" for k in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS MATERIALIZED (
  SELECT r, d, d * {parts} // (max(d) OVER () + 1) AS p, x FROM (
    SELECT r, unnest(range(len(embedding))) AS d,
      unnest(list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT)) AS x FROM v)
), b0 AS MATERIALIZED (
  SELECT p, d, r - 1 AS e, x FROM c WHERE r <= {entries}
),{steps},{near(rounds)}, coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error
  FROM a{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, d)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN v USING (r)
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_sharding,
        op3_best_fit_packing,
        op4_benchmark_decontamination,
        op5_language_id,
        op6_simhash_near_dedup,
        op7_quality_rules,
        op8_line_dedup,
        op9_license_scans,
        op10_secret_scans,
        op11_document_fingerprints,
        op12_periodic_runs,
        op13_vector_codes,
    )
}
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op13_vector_codes": _vector_codes_sql(),
    "op4_benchmark_decontamination": r"""
WITH dw AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents)
), iw AS (
  SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS j, len(ws) AS n
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark)
), same AS (
  SELECT doc_id, item_id, i - j AS d, j, n FROM dw JOIN iw USING (w)
), lying AS (
  SELECT doc_id, item_id, d, n, count(*) OVER (
      PARTITION BY doc_id, item_id, d ORDER BY j RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS near
  FROM same
), found AS (
  SELECT doc_id, item_id, d, n, count(*) AS n_matched FROM lying
  GROUP BY doc_id, item_id, d, n
  HAVING max(near) >= least(13, n) - if(n < 8, 0, floor(least(13, n) * 2 / 13))
)
SELECT doc_id, item_id, d AS at_word, n_matched, n AS n_item_words,
  n_matched::DOUBLE / n AS overlap
FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, d) = 1
""",
    "op7_quality_rules": rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), line AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM w
), spoken AS (
  SELECT doc_id, source, l, lower(trim(l, {_BLANK})) AS k,
    len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
  FROM line WHERE trim(l, {_BLANK}) <> ''
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM spoken GROUP BY doc_id
), gram AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), again AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM twice, range(8) t(d) GROUP BY doc_id
), often AS (
  SELECT source, k FROM spoken GROUP BY source, k HAVING count(DISTINCT doc_id) > {quality.MAX_DOCS}
), gone AS (
  SELECT doc_id, count(*) AS removed_lines, sum(n) AS removed_words
  FROM spoken s JOIN often o ON s.source IS NOT DISTINCT FROM o.source AND s.k = o.k GROUP BY doc_id
), base AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(removed_lines, 0)::BIGINT AS removed_lines,
    coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id)
), ruled AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
)
SELECT *, NOT base_failed AND n_words - removed_words >= {quality.MIN_LEFT}
  AND n_words - removed_words >= {quality.MIN_SHARE} * n_words AS kept
FROM ruled
""",
    "op8_line_dedup": f"""
WITH line AS (
  SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(l, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, l, i, last IS NOT NULL AND last <> doc_id AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
