"""Queries of the text problems (1, 2, 3, 7, 8 and 9) and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import handwritten, mixing, packing, pii, terms, tokens
from quern.session import cut, table


def p1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The ignore patterns are a project's settings, a few lines in order.
    patterns = [r["pattern"] for r in table(spark, sf_dir, "ignore_patterns").orderBy("pos").collect() if r["pattern"]]
    return handwritten.not_handwritten(table(spark, sf_dir, "source_files"), patterns)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_files(spark, sf_dir).select("path")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_terms(spark, sf_dir).where("mark IS NOT NULL").select("token_scope", "token")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = terms.term_counts(table(spark, sf_dir, "postings"))
    return terms.mark_terms(counts, table(spark, sf_dir, "term_limits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A case depends on how many components hold a token alone; the pairs with their scores are p3_pairs.
    return terms.rare_pairs(terms.token_frequencies(table(spark, sf_dir, "postings"))).select("component_a", "component_b")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.rare_pairs(terms.distinctive_terms(table(spark, sf_dir, "postings"))).withColumn("score", F.round("score", 9))


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.distinctive_terms(table(spark, sf_dir, "postings")).withColumn("score", F.round("score", 9))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = table(spark, sf_dir, "containers").select("container_kind", "capacity_tokens").distinct().collect()
    return packing.pack(sizes, [(r["container_kind"], r["capacity_tokens"]) for r in kinds])


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.usage(_packed(spark, sf_dir), table(spark, sf_dir, "containers"))


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = tokens.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    # Counted once: the sizes decide the rates, and the rates the repeats.
    return mixing.repeats(cut(sized), table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicated(_repeated(spark, sf_dir))


def p8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_repeated(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "given_names"))
    return found.select("doc_id", "pii_kind", "pii_text").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "given_names"))


QUERIES = {
    "p1_found": p1_found,
    "p1_files": p1_files,
    "p2_found": p2_found,
    "p2_terms": p2_terms,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p3_scores": p3_scores,
    "p7_containers": p7_containers,
    "p7_usage": p7_usage,
    "p8_mixture": p8_mixture,
    "p8_repeats": p8_repeats,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

_CLEAN = """
WITH rows AS (
  SELECT nullif(lower(regexp_replace(regexp_replace(token, '^\\s+', ''), '\\s+$', '')), '') AS token, component_id, origin
  FROM postings WHERE component_id IS NOT NULL
), cleaned AS (SELECT * FROM rows WHERE token IS NOT NULL)
"""

_P2 = (
    _CLEAN
    + """, scoped AS (
  SELECT 'all' AS token_scope, token, component_id FROM cleaned
  UNION ALL SELECT 'name', token, component_id FROM cleaned WHERE origin = 'name'
), sizes AS (SELECT token_scope, count(DISTINCT component_id) AS n_all FROM scoped GROUP BY 1),
counts AS (
  SELECT token_scope, token, count(*) AS n_rows, count(DISTINCT component_id) AS n_components FROM scoped GROUP BY 1, 2
), marked AS (
  SELECT c.*, s.n_all, CASE WHEN n_components < l.min_components THEN 'rare'
                            WHEN n_components / s.n_all > l.max_share THEN 'common' END AS mark
  FROM counts c JOIN sizes s USING (token_scope) LEFT JOIN term_limits l USING (token_scope)
)
"""
)

ORACLE = {
    "p2_found": _P2 + "SELECT token_scope, token FROM marked WHERE mark IS NOT NULL",
    "p2_terms": _P2 + "SELECT * FROM marked",
    "p3_found": _CLEAN
    + """, held AS (SELECT DISTINCT token, component_id FROM cleaned),
    rare AS (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM held)
    SELECT a.component_id AS component_a, b.component_id AS component_b
    FROM rare a JOIN rare b ON a.token = b.token AND a.component_id < b.component_id
    WHERE a.df <= 3 GROUP BY 1, 2 HAVING count(*) >= 2""",
}
