"""The queries of the general data problems (1 to 4), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.operators.mixed_times import normalise_times
from vulnlake.operators.nested import CHILD_MEMBERS, child_values, flatten
from vulnlake.operators.packed import split_packed
from vulnlake.operators.snapshots import diff_snapshots
from vulnlake.session import table

#: Columns of an exploit entry whose change counts.
ENTRY_COLUMNS = ["title", "source_url", "exploit_type", "maturity", "verification_status"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(table(spark, sf_dir, "exploits"), "identifiers", ["exploit_row"], "identifier")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "source_registry")
    records = normalise_times(
        table(spark, sf_dir, "source_records"), "record_no", "source_code", ["published_at", "modified_at"], registry, "source_records"
    )
    exploits = normalise_times(table(spark, sf_dir, "exploits"), "exploit_row", "source_code", ["published_at"], registry, "exploits")
    return records.unionByName(exploits).select("table_name", "row_no", "field_name", "utc_micros")


def p2_unregistered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is known of the sources, so the path through each source's records
    decides between the readings; times without zone are taken as UTC."""
    records = table(spark, sf_dir, "source_records")
    found = normalise_times(records, "record_no", "source_code", ["published_at", "modified_at"], None, "source_records")
    return found.select("table_name", "row_no", "field_name", "utc_micros")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff_snapshots(
        table(spark, sf_dir, "exploits"), table(spark, sf_dir, "exploit_snapshots"), "source_key", "exploit_row", "is_active", ENTRY_COLUMNS
    )
    return found.select("source_code", F.col("entry_key").alias("source_key"), "snapshot_id", "change_kind")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, relations = flatten(table(spark, sf_dir, "evidence_records"), "evidence_no", "evidence_json", CHILD_MEMBERS)
    return child_values(rows, relations, "evidence_no")


def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flat tables, one row per element with its links; columns as JSON."""
    rows, _ = flatten(table(spark, sf_dir, "evidence_records"), "evidence_no", "evidence_json")
    return rows.select(F.col("doc").alias("evidence_no"), "relation", "row_id", "parent_relation", "parent_id", "tree_id", "pos", F.to_json("members").alias("columns_json"))


P3_SQL = """
WITH ordered AS (
  SELECT source_code, snapshot_id, row_number() OVER (PARTITION BY source_code ORDER BY delivered, snapshot_id) AS place
  FROM (SELECT source_code, snapshot_id, min(delivered_at) AS delivered FROM exploit_snapshots WHERE is_complete GROUP BY 1, 2)
), ranked AS (
  SELECT e.*, o.place, row_number() OVER (PARTITION BY e.source_code, o.place, e.source_key ORDER BY e.exploit_row DESC) AS rn
  FROM exploits e JOIN ordered o ON e.source_code = o.source_code AND e.snapshot_id = o.snapshot_id
  WHERE e.source_key IS NOT NULL
), present AS (
  SELECT source_code, place, source_key,
    concat_ws('|', coalesce(trim(title, E' \\t\\r\\n'), ''), coalesce(trim(source_url, E' \\t\\r\\n'), ''), coalesce(trim(exploit_type, E' \\t\\r\\n'), ''),
      coalesce(trim(maturity, E' \\t\\r\\n'), ''), coalesce(trim(verification_status, E' \\t\\r\\n'), '')) AS content
  FROM ranked WHERE rn = 1 AND coalesce(is_active, true)
), pairs AS (
  SELECT coalesce(n.source_code, t.source_code) AS source_code, coalesce(n.source_key, t.source_key) AS source_key,
    coalesce(n.place, t.place + 1) AS place, n.content AS now, t.content AS before
  FROM present n FULL OUTER JOIN present t ON n.source_code = t.source_code AND n.source_key = t.source_key AND n.place = t.place + 1
)
SELECT p.source_code, p.source_key, o.snapshot_id,
  CASE WHEN before IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM pairs p JOIN ordered o ON p.source_code = o.source_code AND p.place = o.place
WHERE p.place > 1 AND now IS DISTINCT FROM before
"""

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_unregistered": p2_unregistered, "p3_found": p3_found, "p4_found": p4_found, "p4_tables": p4_tables}
SQL = {"p3_found": P3_SQL}
