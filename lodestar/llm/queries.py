"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.line_dedup import dedup_digests

    return dedup_digests(table(sf_dir, "documents", spark))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.token_counts import token_counts

    return token_counts(table(sf_dir, "documents", spark), tokenizer_path("piece_bpe_32k.model"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.ngram_join import jaccard_components

    return jaccard_components(table(sf_dir, "documents", spark))


def op4_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.media_gif import gif_digests

    return gif_digests(table(sf_dir, "documents", spark))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.toxicity import toxicity_scores

    return toxicity_scores(table(sf_dir, "documents", spark), table(sf_dir, "labels", spark))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.quality import quality_scores

    return quality_scores(table(sf_dir, "documents", spark), table(sf_dir, "labels", spark))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.packing import pack

    return pack(table(sf_dir, "documents", spark), tokenizer_path("byte_bpe_50k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.decontam import contaminated

    return contaminated(table(sf_dir, "documents", spark), table(sf_dir, "benchmark", spark))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.lm_score import lm_scores

    return lm_scores(table(sf_dir, "documents", spark))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.pii import find_pii

    return find_pii(table(sf_dir, "documents", spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_token_counts, op3_ngram_jaccard, op4_media_gif, op5_toxicity, op6_quality, op7_packing, op8_decontamination, op9_lm_score, op10_pii)
}

SQL = {
    "op1_line_dedup": r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM split),
keyed AS (
  SELECT doc_id, pos, lines[pos] AS line,
    translate(trim(lines[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM numbered),
often AS (SELECT key, max(doc_id) AS kept FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND o.kept <> k.doc_id AS dropped FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT linked.b, reach.c FROM reach JOIN linked ON linked.a = reach.doc_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(reach.c) AS component_id FROM s JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id, s.sh
""",
}
