"""Registered queries of the training-data operators and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import bpe, ctw, decontaminate, hard_negatives, langid, line_dedup, near_dedup, pii, quality, resampling, suffix_dedup
from pairwright.llm.secret_scan import scan_secrets
from pairwright.llm.sharding import shard_by_bytes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_files() -> tuple[str, str]:
    """(rank file, split pattern) of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_minhash_odd_sketch(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return near_dedup.near_groups(documents(spark, sf_dir))


def op2_perplexity_bands(spark, sf_dir):
    """Base statistics and perplexity bands of every whole text."""
    return quality.quality_rules(documents(spark, sf_dir))


def op3_byte_bpe(spark, sf_dir):
    """Byte-level BPE ids of every whole text, decoded again."""
    return bpe.digests(documents(spark, sf_dir), *tokenizer_files())


def op5_context_tree_weighting(spark, sf_dir):
    """Context-tree-weighting and word-count scores of every whole text."""
    return ctw.score_texts(documents(spark, sf_dir))


def op6_suffix_dedup(spark, sf_dir):
    """Every whole text without the bytes of its repeated 200-byte strings."""
    return suffix_dedup.removal_digests(documents(spark, sf_dir))


def op7_boosted_pii(spark, sf_dir):
    """Personal data spans of every whole text: base patterns and boosted candidates."""
    return pii.find_pii(documents(spark, sf_dir))


def op8_cgk_decontamination(spark, sf_dir):
    """Benchmark items found in whole documents: one row for each document and item, none for clean ones."""
    hits = decontaminate.find_passages(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.withColumn("kept", F.lit(False))


def op9_language_id(spark, sf_dir):
    """Language of every whole text by hyperdimensional profiles."""
    return langid.identify(documents(spark, sf_dir))


def op4_secret_scan(spark, sf_dir):
    """Secret spans of every whole text: fixed patterns and entropy windows."""
    return scan_secrets(documents(spark, sf_dir))


def op10_byte_shards(spark, sf_dir):
    """All documents in 40 contiguous shards of near-equal bytes."""
    return shard_by_bytes(documents(spark, sf_dir), n_shards=40)


def op11_str_rtree_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector, searched against all vectors."""
    return hard_negatives.mine_hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=hard_negatives.shifted_label())


def op12_importance_resampling(spark, sf_dir):
    """All documents weighed towards the benchmark's n-grams; a twentieth of those with 20 words is drawn."""
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_line_dedup(spark, sf_dir):
    """All documents without their repeated lines, by levelled runs of line hashes."""
    return line_dedup.line_digests(documents(spark, sf_dir))


QUERIES = {
    "op1_minhash_odd_sketch": op1_minhash_odd_sketch,
    "op2_perplexity_bands": op2_perplexity_bands,
    "op3_byte_bpe": op3_byte_bpe,
    "op5_context_tree_weighting": op5_context_tree_weighting,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_boosted_pii": op7_boosted_pii,
    "op8_cgk_decontamination": op8_cgk_decontamination,
    "op9_language_id": op9_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op10_byte_shards": op10_byte_shards,
    "op11_str_rtree_negatives": op11_str_rtree_negatives,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_line_dedup": op13_line_dedup,
}

#: Near-duplicate links by comparing all sets, and their components.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT doc_id, doc_id AS r FROM sets
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.r) AS component_id, s.doc_id = min(r.r) AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""

#: Hard negatives by comparing each anchor with all rows.
OP11_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT ar, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS p
  FROM scored WHERE same QUALIFY p <= 5
), neg AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.p ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM pos p JOIN scored n ON n.ar = p.ar AND NOT n.same
   AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
  QUALIFY rank <= 10
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg
"""

#: Lines of all documents, counted and joined again.
OP13_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> top, false) AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_minhash_odd_sketch": OP1_SQL, "op11_str_rtree_negatives": OP11_SQL, "op13_line_dedup": OP13_SQL}
