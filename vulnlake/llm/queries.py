"""Queries of the language-model data problems (5 to 8), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vulnlake.llm.consensus import best_representatives
from vulnlake.llm.leakage import item_report, leaked_pairs
from vulnlake.llm.mixing import document_sizes, mix_shares, select_mix
from vulnlake.llm.residue import residue_documents
from vulnlake.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_representatives(table(spark, sf_dir, "source_records"), table(spark, sf_dir, "source_registry"), ["title", "description"])


def p5_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies add up, so the vote of the tokens decides."""
    return best_representatives(table(spark, sf_dir, "source_records"), table(spark, sf_dir, "source_registry"), ["title", "description"], weights="additive")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return select_mix(document_sizes(table(spark, sf_dir, "documents"), targets), targets)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mix_shares(document_sizes(table(spark, sf_dir, "documents"), targets), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(table(spark, sf_dir, "documents"))


QUERIES = {"p5_found": p5_found, "p5_consensus": p5_consensus, "p6_found": p6_found, "p6_items": p6_items, "p7_selection": p7_selection, "p7_shares": p7_shares, "p8_found": p8_found}
SQL = {
    "p6_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items) WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM i) s WHERE len(d.w) >= s.n))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g)
""",
}
