"""Evidence reads, quality reports and audits over the domain views."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.operators import delta as D
from vulnlake.operators import evidence as E
from vulnlake.operators import quality as Q
from vulnlake.plans.domain import oracle, view
from vulnlake.queries.catalog import CATALOG, COMPONENTS, OWNERS, _catalog
from vulnlake.operators.catalog import alias_owners


def _changed_records(records):
    """The last record per key, one with an odd number if there is one, is known; a quarter by number is not. Even numbers come in with another hash, odd ones as known."""
    known = E.keep_last(records, ["source_code", "source_record_id"], [F.col("record_no") % 2, "record_no"])
    incoming = records.where("record_no % 2 = 0").withColumn("record_hash", F.concat("record_hash", F.lit("-new"))).unionByName(known.where("record_no % 2 = 1"))
    return D.changed_records(known.where("record_no % 4 <> 0"), incoming)


def _stale_owners(owners):
    """Owners of which a sixteenth still names the key before a rename."""
    old = F.substring(F.md5("identifier"), 1, 1) == "0"
    return owners.withColumn("vulnerability_key", F.when(old, F.concat(F.lit("OLD-"), "vulnerability_key")).otherwise(F.col("vulnerability_key")))


#: What is counted beside the two projections.
COUNTED = ["source_records", "source_record_identifiers", "exploits", "evidence_records", "documents", "v_relations", "v_facts", "v_severity", "v_references", "v_weaknesses", "v_threat"]
FACT_COLUMNS = ["vulnerability_key", "source_code", "package_name", "raw_index_id", "line", "rn"]
QUERIES = {
    "w03_top_facts": lambda s, d: E.top_facts(view(s, d, "v_facts"), 3).select(*FACT_COLUMNS),
    "w04_top_references": lambda s, d: E.top_references(view(s, d, "v_references"), 2).select("vulnerability_key", "source_code", "url", "source_record_id", "raw_index_id", "rn"),
    "w05_top_severity": lambda s, d: E.top_severity(view(s, d, "v_severity"), 5).select("vulnerability_key", "source_code", "raw_index_id", "score", "line", "rn", "is_selected"),
    "w06_top_weaknesses": lambda s, d: E.top_weaknesses(view(s, d, "v_weaknesses"), 4).select("vulnerability_key", "weakness_id", "source_code", "source_record_id", "rn"),
    "w07_top_components": lambda s, d: E.top_components(_catalog(s, d)[1], 5).select("vulnerability_id", "id", "range_type", "rn"),
    "w01_sweep_duplicates": lambda s, d: E.sweep_duplicates(view(s, d, "exploits")).select("exploit_row", F.coalesce("is_active", F.lit(True)).alias("is_active")),
    "d01_keep_last": lambda s, d: E.keep_last(view(s, d, "v_records"), ["source_code", "source_record_id"], ["record_no"]).select("source_code", "source_record_id", "record_no", "title"),
    "d03_distinct_facts": lambda s, d: E.distinct_facts(view(s, d, "v_facts")).select("source_code", "source_record_id", "fact_type", "ecosystem", "package_name", "version_range_raw", "range_type", "vulnerable"),
    "d04_distinct_references": lambda s, d: E.distinct_references(view(s, d, "v_references")).select("source_code", "source_record_id", "raw_index_id", "url"),
    "d05_distinct_weaknesses": lambda s, d: E.distinct_weaknesses(view(s, d, "v_weaknesses")).select("source_code", "source_record_id", "weakness_type", "weakness_id"),
    "d14_compact_severity": lambda s, d: E.compact_severity(view(s, d, "v_severity")),
    "j04_relation_references": lambda s, d: E.relation_references(view(s, d, "v_relations"), view(s, d, "v_records")),
    "a28_relation_sets": lambda s, d: E.relation_sets(view(s, d, "v_relations")),
    "a29_source_urls": lambda s, d: E.source_urls(view(s, d, "v_records")),
    "p14_exploits_of": lambda s, d: E.exploits_of(view(s, d, "exploits"), "CVE-2023-1999999").select("exploit_row", "source_code", "source_key"),
    "a09_ecosystem_packages": lambda s, d: Q.ecosystem_packages(_catalog(s, d)[1], 50),
    "a10_package_totals": lambda s, d: Q.package_totals(_catalog(s, d)[1]),
    "a11_matching_quality": lambda s, d: Q.matching_quality(view(s, d, "v_facts")),
    "a12_source_coverage": lambda s, d: Q.source_coverage(view(s, d, "v_records")),
    "a13_ecosystem_coverage": lambda s, d: Q.ecosystem_coverage(view(s, d, "v_facts")),
    "a15_multi_owner_identifiers": lambda s, d: Q.multi_owner_identifiers(view(s, d, "v_identifiers_shared")),
    "a16_snapshot_stats": lambda s, d: Q.snapshot_stats(view(s, d, "exploits")),
    "a19_table_counts": lambda s, d: Q.table_counts({n: view(s, d, n) for n in COUNTED} | dict(zip(("vulnerabilities", "affected_components"), _catalog(s, d)))),
    "a20_audit_catalog": lambda s, d: Q.audit_catalog(_catalog(s, d)[0]),
    "a21_audit_relations": lambda s, d: Q.audit_relations(view(s, d, "v_relations")),
    "a22_severity_distribution": lambda s, d: Q.severity_distribution(_catalog(s, d)[0]),
    "a23_audit_gaps": lambda s, d: Q.audit_gaps(_catalog(s, d)[0], facts=view(s, d, "v_facts"), references=view(s, d, "v_references"), weaknesses=view(s, d, "v_weaknesses")),
    "a24_source_gaps": lambda s, d: Q.source_gaps(view(s, d, "v_records")),
    "a25_orphans": lambda s, d: Q.orphans(view(s, d, "v_facts"), view(s, d, "v_weaknesses"), "vulnerability_key"),
    "a26_version_distribution": lambda s, d: Q.version_distribution(view(s, d, "v_records")),
    "j16_mismatched_owners": lambda s, d: Q.mismatched_owners(_stale_owners(alias_owners(view(s, d, "v_identifiers"), view(s, d, "v_records"))), _catalog(s, d)[0]),
    "j17_compare_sets": lambda s, d: Q.compare_sets(view(s, d, "v_facts"), view(s, d, "v_weaknesses"), "vulnerability_key"),
    "a31_alias_histogram": lambda s, d: Q.counts_of(view(s, d, "v_identifiers").groupBy("source_code", "source_record_id").agg(F.count_distinct("identifier").alias("aliases")), F.col("aliases"), "aliases"),
    "a32_exploits_by_source": lambda s, d: Q.counts_of(view(s, d, "exploits"), F.col("source_code"), "source_code"),
    "p24_bad_scores": lambda s, d: Q.bad_scores(view(s, d, "v_threat_feed")).select("vulnerability_key", "score"),
    "p25_changed_records": lambda s, d: _changed_records(view(s, d, "v_records")).select("record_no"),
    "m01_replace_by_keys": lambda s, d: D.replace_by_keys(view(s, d, "v_facts"), view(s, d, "v_facts").where("line = 1 and source_code = 'osv'"), ["source_code", "source_record_id"]).select("source_code", "source_record_id", "raw_index_id", "line"),
    "m03_reset_source": lambda s, d: D.reset_source(view(s, d, "v_records"), "osv").select("source_code", "record_no"),
    "m04_score_delta": lambda s, d: D.score_delta(view(s, d, "v_threat").select("vulnerability_key", "score", "percentile", "observed_at"), view(s, d, "v_threat_new").withColumn("observed_at", F.lit("2026-02-02"))),
    "m06_upsert_exploits": lambda s, d: D.upsert_exploits(
        E.keep_last(view(s, d, "exploits").where("exploit_row % 2 = 0"), ["source_code", "raw_index_id"], ["exploit_row"]),
        E.keep_last(view(s, d, "exploits").where("exploit_row % 2 = 1"), ["source_code", "raw_index_id"], ["exploit_row"]),
    ).select("source_code", "raw_index_id", "title", "snapshot_id", "is_active"),
    "u05_changed_keys": lambda s, d: D.changed_keys(view(s, d, "v_facts"), view(s, d, "v_weaknesses")),
}

HAS = lambda c: f"CASE WHEN coalesce({c}, '') <> '' THEN 0 ELSE 1 END"
BLANK = lambda c: f"count_if(trim(coalesce({c}, '')) = '')"
LASTX = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(source_code), lower(coalesce(raw_index_id, '')) ORDER BY exploit_row DESC) AS rn FROM {exploits} WHERE exploit_row % 2 = PARITY) WHERE rn = 1"
_SQL = {
    "w03_top_facts": f"""SELECT * FROM (SELECT vulnerability_key, source_code, package_name, raw_index_id, line, row_number() OVER (PARTITION BY vulnerability_key
  ORDER BY {HAS('cpe23_uri')}, {HAS('purl')}, source_code, package_name NULLS LAST, raw_index_id, line) AS rn FROM {{v_facts}}) WHERE rn <= 3""",
    "w04_top_references": "SELECT * FROM (SELECT vulnerability_key, source_code, url, source_record_id, raw_index_id, row_number() OVER (PARTITION BY vulnerability_key ORDER BY source_code, url, source_record_id, raw_index_id) AS rn FROM {v_references}) WHERE rn <= 2",
    "w05_top_severity": f"""SELECT *, rn = 1 AS is_selected FROM (SELECT vulnerability_key, source_code, raw_index_id, score, line, row_number() OVER (PARTITION BY vulnerability_key
  ORDER BY {HAS('vector_string')}, score DESC NULLS LAST, source_code, raw_index_id, line) AS rn FROM {{v_severity}}) WHERE rn <= 5""",
    "w06_top_weaknesses": f"SELECT * FROM (SELECT vulnerability_key, weakness_id, source_code, source_record_id, row_number() OVER (PARTITION BY vulnerability_key ORDER BY {HAS('weakness_id')}, weakness_id NULLS LAST, source_code, source_record_id) AS rn FROM {{v_weaknesses}}) WHERE rn <= 4",
    "w07_top_components": f"""SELECT vulnerability_id, id, range_type, rn FROM (SELECT *, row_number() OVER (PARTITION BY vulnerability_id ORDER BY CASE WHEN lower(range_type) IN ('ecosystem', 'semver') THEN 0 ELSE 1 END,
  {HAS('normalized_range')}, ecosystem NULLS LAST, display_name, id, range_type, source_code) AS rn FROM ({COMPONENTS})) WHERE rn <= 5""",
    "w01_sweep_duplicates": """SELECT exploit_row, CASE WHEN coalesce(is_active, true) THEN rn = 1 ELSE false END AS is_active FROM
  (SELECT *, row_number() OVER (PARTITION BY source_code, raw_index_id, coalesce(is_active, true) ORDER BY coalesce(modified_at, '') DESC, exploit_row DESC) AS rn FROM {exploits})""",
    "d01_keep_last": "SELECT source_code, source_record_id, record_no, title FROM (SELECT *, row_number() OVER (PARTITION BY lower(source_code), lower(source_record_id) ORDER BY record_no DESC) AS rn FROM {v_records}) WHERE rn = 1",
    "d03_distinct_facts": "SELECT source_code, source_record_id, fact_type, ecosystem, package_name, version_range_raw, range_type, vulnerable FROM (SELECT DISTINCT source_code, source_record_id, fact_type, ecosystem, package_name, purl, cpe23_uri, version_range_raw, range_type, vulnerable FROM {v_facts})",
    "d04_distinct_references": "SELECT source_code, source_record_id, raw_index_id, url FROM (SELECT *, row_number() OVER (PARTITION BY lower(source_code), lower(source_record_id), lower(url) ORDER BY raw_index_id) AS rn FROM {v_references} WHERE trim(url) <> '') WHERE rn = 1",
    "d05_distinct_weaknesses": "SELECT DISTINCT source_code, source_record_id, weakness_type, weakness_id FROM {v_weaknesses} WHERE coalesce(weakness_id, '') <> ''",
    "d14_compact_severity": "SELECT vulnerability_key, scoring_system, scoring_version, vector_string, score, severity_label, count(DISTINCT source_code) AS source_count FROM {v_severity} GROUP BY 1, 2, 3, 4, 5, 6",
    "j04_relation_references": """WITH j AS (SELECT r.* FROM {v_relations} r JOIN (SELECT DISTINCT source_code, source_record_id FROM {v_records}) s ON r.source_code = s.source_code AND r.source_record_id = s.source_record_id)
SELECT DISTINCT * FROM (SELECT vulnerability_key, 'out' AS direction, relation_type, related_identifier AS other FROM j UNION ALL SELECT related_identifier, 'in', relation_type, vulnerability_key FROM j) WHERE vulnerability_key <> other""",
    "a28_relation_sets": """SELECT vulnerability_key, coalesce(cast(to_json(list_sort(list(DISTINCT upper(related_identifier)) FILTER (WHERE relation_type = 'upstream'))) AS VARCHAR), '[]') AS upstream_json,
  coalesce(cast(to_json(list_sort(list(DISTINCT upper(related_identifier)) FILTER (WHERE relation_type = 'related'))) AS VARCHAR), '[]') AS related_json FROM {v_relations} GROUP BY 1""",
    "a29_source_urls": "SELECT vulnerability_key, source_code, arg_min(source_url, (source_record_id, source_url)) AS source_url FROM {v_records} WHERE trim(source_url) <> '' GROUP BY 1, 2",
    "p14_exploits_of": "SELECT exploit_row, source_code, source_key FROM {exploits} WHERE coalesce(is_active, true) AND contains(identifiers, 'CVE-2023-1999999')",
    "a09_ecosystem_packages": f"SELECT lower(ecosystem) AS ecosystem_lower, display_name, count(DISTINCT vulnerability_id) AS cves, count(*) AS components FROM ({COMPONENTS}) GROUP BY 1, 2 ORDER BY cves DESC, 1, 2 LIMIT 50",
    "a10_package_totals": f"SELECT display_name, count(DISTINCT vulnerability_id) AS cves, count(DISTINCT lower(ecosystem)) AS ecosystems, count(*) AS components FROM ({COMPONENTS}) GROUP BY 1",
    "a11_matching_quality": """SELECT lower(ecosystem) AS ecosystem, count(*) AS facts, count(DISTINCT vulnerability_key) AS vulnerabilities, cast(count_if(coalesce(purl, '') <> '') AS BIGINT) AS with_purl, cast(count_if(coalesce(cpe23_uri, '') <> '') AS BIGINT) AS with_cpe,
  cast(count_if(coalesce(version_range_raw, '') = '') AS BIGINT) AS no_range, cast(count_if(regexp_matches(coalesce(version_range_raw, ''), '^\\s*>=?\\s*0(\\.0)*\\s*$')) AS BIGINT) AS open_lower_bound,
  cast(count_if(coalesce(version_range_raw, '') <> '' AND NOT regexp_matches(version_range_raw, '(<=|>=|==|=|<|>)')) AS BIGINT) AS unparseable FROM {v_facts} GROUP BY 1""",
    "a12_source_coverage": "SELECT source_code, count(*) AS records, count(DISTINCT vulnerability_key) AS keys, max(nullif(modified_at, '')) AS last_modified FROM {v_records} GROUP BY 1",
    "a13_ecosystem_coverage": "SELECT ecosystem, count(*) AS facts, cast(count_if(vulnerable) AS BIGINT) AS vulnerable_facts, cast(count_if(coalesce(version_range_raw, '') <> '') AS BIGINT) AS ranged_facts FROM {v_facts} GROUP BY 1",
    "a15_multi_owner_identifiers": "SELECT identifier, count(DISTINCT vulnerability_key) AS owners FROM {v_identifiers_shared} GROUP BY 1 HAVING count(DISTINCT vulnerability_key) > 1",
    "a16_snapshot_stats": "SELECT source_code, count(*) AS active, count(DISTINCT raw_index_id) AS raw_ids FROM {exploits} WHERE coalesce(is_active, true) GROUP BY 1",
    "a19_table_counts": " UNION ALL ".join([*(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {{{n}}}" for n in COUNTED), f"SELECT 'vulnerabilities', count(*) FROM ({CATALOG})", f"SELECT 'affected_components', count(*) FROM ({COMPONENTS})"]),
    "a20_audit_catalog": f"SELECT count(*) AS n_rows, cast({BLANK('title')} AS BIGINT) AS blank_titles, cast({BLANK('description')} AS BIGINT) AS blank_descriptions, cast(count_if(affected_component_count = 0) AS BIGINT) AS without_components FROM ({CATALOG})",
    "a21_audit_relations": "SELECT count(*) AS n_rows, cast(count_if(vulnerability_key = related_identifier) AS BIGINT) AS self_relations, count(*) - count(DISTINCT concat_ws('|', source_code, source_record_id, relation_type, related_identifier)) AS repeats, cast(count_if(trim(related_identifier) = '') AS BIGINT) AS blanks FROM {v_relations}",
    "a22_severity_distribution": f"SELECT coalesce(severity_label, 'UNRATED') AS severity, count(*) AS n_rows FROM ({CATALOG}) GROUP BY 1",
    "a23_audit_gaps": f"""SELECT count(*) AS n_rows, cast(count_if(primary_identifier NOT IN (SELECT vulnerability_key FROM {{v_facts}})) AS BIGINT) AS without_facts,
  cast(count_if(primary_identifier NOT IN (SELECT vulnerability_key FROM {{v_references}})) AS BIGINT) AS without_references, cast(count_if(primary_identifier NOT IN (SELECT vulnerability_key FROM {{v_weaknesses}})) AS BIGINT) AS without_weaknesses FROM ({CATALOG})""",
    "a24_source_gaps": f"SELECT source_code, count(*) AS records, cast({BLANK('title')} AS BIGINT) AS blank_titles, cast({BLANK('description')} AS BIGINT) AS blank_descriptions, cast({BLANK('source_url')} AS BIGINT) AS blank_urls FROM {{v_records}} GROUP BY 1",
    "a25_orphans": "SELECT count(*) AS n_rows, cast(count_if(vulnerability_key NOT IN (SELECT vulnerability_key FROM {v_weaknesses})) AS BIGINT) AS orphans, count(vulnerability_key) - count(DISTINCT vulnerability_key) AS repeats FROM {v_facts}",
    "a26_version_distribution": "SELECT coalesce(normalizer_version, 'none') AS normalizer_version, count(*) AS records FROM {v_records} GROUP BY 1",
    "j16_mismatched_owners": f"SELECT o.identifier, o.vulnerability_key, c.primary_identifier FROM (SELECT identifier, vulnerability_id, CASE WHEN substr(md5(identifier), 1, 1) = '0' THEN 'OLD-' || vulnerability_key ELSE vulnerability_key END AS vulnerability_key FROM ({OWNERS})) o JOIN ({CATALOG}) c ON o.vulnerability_id = c.id WHERE o.vulnerability_key <> c.primary_identifier",
    "j17_compare_sets": """SELECT coalesce(a.k, b.k) AS vulnerability_key, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side
FROM (SELECT DISTINCT vulnerability_key AS k FROM {v_facts}) a FULL OUTER JOIN (SELECT DISTINCT vulnerability_key AS k FROM {v_weaknesses}) b ON a.k = b.k""",
    "a31_alias_histogram": "SELECT aliases, count(*) AS n_rows FROM (SELECT source_code, source_record_id, count(DISTINCT identifier) AS aliases FROM {v_identifiers} GROUP BY 1, 2) GROUP BY 1",
    "a32_exploits_by_source": "SELECT source_code, count(*) AS n_rows FROM {exploits} GROUP BY 1",
    "p24_bad_scores": "SELECT vulnerability_key, score FROM {v_threat_feed} WHERE NOT coalesce(regexp_matches(vulnerability_key, '^CVE-[0-9]{4}-[0-9]{4,}$') AND score BETWEEN 0 AND 1 AND percentile BETWEEN 0 AND 1, false)",
    "p25_changed_records": "SELECT record_no FROM {v_records} WHERE record_no % 2 = 0",
    "m01_replace_by_keys": """WITH fresh AS (SELECT * FROM {v_facts} WHERE line = 1 AND source_code = 'osv') SELECT source_code, source_record_id, raw_index_id, line FROM {v_facts} f
WHERE NOT EXISTS (SELECT 1 FROM fresh n WHERE n.source_code = f.source_code AND n.source_record_id = f.source_record_id) UNION ALL SELECT source_code, source_record_id, raw_index_id, line FROM fresh""",
    "m03_reset_source": "SELECT source_code, record_no FROM {v_records} WHERE source_code <> 'osv'",
    "m04_score_delta": """SELECT coalesce(n.vulnerability_key, c.vulnerability_key) AS vulnerability_key,
  CASE WHEN c.vulnerability_key IS NULL OR (n.vulnerability_key IS NOT NULL AND (c.score IS DISTINCT FROM n.score OR c.percentile IS DISTINCT FROM n.percentile)) THEN n.score ELSE c.score END AS score,
  CASE WHEN c.vulnerability_key IS NULL OR (n.vulnerability_key IS NOT NULL AND (c.score IS DISTINCT FROM n.score OR c.percentile IS DISTINCT FROM n.percentile)) THEN n.percentile ELSE c.percentile END AS percentile,
  CASE WHEN c.vulnerability_key IS NULL OR (n.vulnerability_key IS NOT NULL AND (c.score IS DISTINCT FROM n.score OR c.percentile IS DISTINCT FROM n.percentile)) THEN '2026-02-02' ELSE c.observed_at END AS observed_at,
  CASE WHEN c.vulnerability_key IS NULL THEN 'inserted' WHEN n.vulnerability_key IS NULL THEN 'absent' WHEN c.score IS DISTINCT FROM n.score OR c.percentile IS DISTINCT FROM n.percentile THEN 'updated' ELSE 'unchanged' END AS change
FROM {v_threat} c FULL OUTER JOIN {v_threat_new} n ON c.vulnerability_key = n.vulnerability_key""",
    "m06_upsert_exploits": f"""WITH c AS ({LASTX.replace("PARITY", "0")}), n AS ({LASTX.replace("PARITY", "1")})
SELECT coalesce(n.source_code, c.source_code) AS source_code, coalesce(n.raw_index_id, c.raw_index_id) AS raw_index_id, CASE WHEN n.raw_index_id IS NOT NULL THEN n.title ELSE c.title END AS title,
  CASE WHEN n.raw_index_id IS NOT NULL THEN coalesce(n.snapshot_id, c.snapshot_id) ELSE c.snapshot_id END AS snapshot_id, CASE WHEN n.raw_index_id IS NOT NULL THEN true ELSE coalesce(c.is_active, true) END AS is_active
FROM c FULL OUTER JOIN n ON c.source_code = n.source_code AND c.raw_index_id = n.raw_index_id""",
    "u05_changed_keys": "SELECT DISTINCT vulnerability_key FROM (SELECT vulnerability_key FROM {v_facts} UNION ALL SELECT vulnerability_key FROM {v_weaknesses})",
}
SQL = {name: oracle(sql) for name, sql in _SQL.items()}
