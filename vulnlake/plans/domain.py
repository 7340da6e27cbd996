"""Deterministic catalog tables over the test tables, in SQL both engines read.

``{name}`` stands for a table. The same text makes the Spark views and, as
common table expressions, the views of the SQL a query is compared with.

Facts and scores are the line items, all of them, each of a record by its order
number (those of records without key drop out). One package, pkg-0, has a tenth
of the facts and a hundredth of the components of bills.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vulnlake.session import table

VIEWS: dict[str, str] = {
    "v_records": """
SELECT source_code, source_record_id, md5(upper(trim(BOTH ' 	' FROM vulnerability_key))) AS vulnerability_id, upper(trim(BOTH ' 	' FROM vulnerability_key)) AS vulnerability_key,
  title, description, status, published_at, modified_at, source_url, record_hash, normalizer_version, record_no
FROM {source_records} WHERE trim(BOTH ' 	' FROM vulnerability_key) <> '' AND trim(source_record_id) <> '' AND source_code IS NOT NULL""",
    "v_identifiers": """
SELECT source_code, source_record_id, md5(upper(trim(BOTH ' 	' FROM vulnerability_key))) AS vulnerability_id, upper(trim(BOTH ' 	' FROM vulnerability_key)) AS vulnerability_key,
  upper(trim(BOTH ' 	' FROM identifier)) AS identifier
FROM {source_record_identifiers} WHERE trim(BOTH ' 	' FROM vulnerability_key) <> '' AND trim(BOTH ' 	' FROM identifier) <> ''""",
    "v_relations": """
SELECT source_code, source_record_id, vulnerability_id, vulnerability_key,
  CASE WHEN substr(md5(identifier), 1, 1) < '8' THEN 'upstream' ELSE 'related' END AS relation_type, identifier AS related_identifier
FROM {v_identifiers}""",
    "v_facts": """
SELECT r.source_code, 'raw-' || cast(l.l_orderkey AS string) AS raw_index_id, r.vulnerability_key, r.source_record_id,
  CASE WHEN l.l_suppkey % 5 = 4 THEN 'cpe' ELSE 'package' END AS fact_type,
  CASE l.l_suppkey % 7 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'debian:11' WHEN 3 THEN 'debian:12' WHEN 4 THEN 'cargo' WHEN 5 THEN 'crates.io' ELSE 'cpe' END AS ecosystem,
  CASE WHEN l.l_partkey % 13 = 0 THEN '' ELSE l.package END AS package_name,
  CASE WHEN l.l_partkey % 3 = 0 THEN 'pkg:npm/' || l.package || '@1.' || cast(l.l_linenumber AS string) END AS purl,
  CASE WHEN l.l_partkey % 3 = 0 THEN 'pkg:npm/' || l.package END AS purl_without_version,
  CASE WHEN l.l_suppkey % 5 = 4 THEN 'cpe:2.3:a:vendor' || cast(l.l_suppkey % 3 AS string) || ':' || l.package || ':*:*:*:*:*:*:*:*' END AS cpe23_uri,
  CASE l.l_linenumber % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '>= 0' WHEN 3 THEN 'all versions'
    ELSE '>= ' || cast(l.l_linenumber AS string) || '.0, < ' || cast(l.l_partkey % 9 + 1 AS string) || '.5' END AS version_range_raw,
  CASE WHEN l.l_linenumber % 2 = 0 THEN 'ECOSYSTEM' ELSE 'SEMVER' END AS range_type, l.l_returnflag <> 'R' AS vulnerable, l.l_linenumber AS line
FROM (SELECT *, l_orderkey % (SELECT max(record_no) + 1 FROM {source_records}) AS owner, 'pkg-' || cast(CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE l_partkey END AS string) AS package FROM {lineitem}) l JOIN {v_records} r ON l.owner = r.record_no""",
    "v_severity": """
SELECT r.source_code, 'raw-' || cast(l.l_orderkey AS string) AS raw_index_id, r.vulnerability_key, r.source_record_id, 'cvss' AS scoring_system,
  CASE l.l_linenumber % 3 WHEN 0 THEN '2.0' WHEN 1 THEN '3.0' ELSE '3.1' END AS scoring_version,
  CASE WHEN l.l_partkey % 4 = 0 THEN NULL WHEN l.l_linenumber % 3 = 0 THEN 'AV:N/AC:L/Au:N/C:P/I:P/A:' || CASE WHEN l.l_partkey % 2 = 0 THEN 'P' ELSE 'N' END
    WHEN l.l_linenumber % 3 = 1 THEN 'CVSS:3.0/AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:H/A:' || CASE WHEN l.l_partkey % 2 = 0 THEN 'H' ELSE 'N' END
    ELSE 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:' || CASE WHEN l.l_partkey % 2 = 0 THEN 'H' ELSE 'N' END END AS vector_string,
  CASE WHEN l.l_suppkey % 9 = 0 THEN NULL ELSE cast(l.l_partkey % 101 AS double) / 10 END AS score,
  CASE WHEN l.l_suppkey % 9 = 0 OR l.l_partkey % 11 = 0 THEN NULL WHEN l.l_partkey % 101 >= 90 THEN 'CRITICAL' WHEN l.l_partkey % 101 >= 70 THEN 'HIGH' ELSE 'MEDIUM' END AS severity_label,
  l.l_linenumber AS line
FROM (SELECT *, l_orderkey % (SELECT max(record_no) + 1 FROM {source_records}) AS owner, 'pkg-' || cast(CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE l_partkey END AS string) AS package FROM {lineitem}) l JOIN {v_records} r ON l.owner = r.record_no WHERE l.l_linenumber <= 3""",
    "v_references": """
SELECT source_code, 'raw-' || cast(record_no AS string) AS raw_index_id, vulnerability_key, source_record_id, source_url AS url, lower(trim(source_url)) AS normalized_url,
  CASE WHEN record_no % 3 = 0 THEN 'ADVISORY' WHEN record_no % 3 = 1 THEN 'FIX' END AS ref_type
FROM {v_records} WHERE trim(source_url) <> ''""",
    "v_weaknesses": """
SELECT source_code, vulnerability_key, source_record_id, 'CWE' AS weakness_type, CASE WHEN record_no % 10 = 0 THEN NULL ELSE 'CWE-' || cast(record_no % 40 AS string) END AS weakness_id
FROM {v_records} WHERE record_no % 2 = 0""",
    "v_threat": """
SELECT 'first-epss' AS source_code, 'CVE-2024-' || CASE WHEN event_id < 100000 THEN lpad(cast(event_id AS string), 5, '0') ELSE cast(event_id AS string) END AS vulnerability_key, 'epss' AS score_type,
  cast((event_id * 37) % 1000 AS double) / 1000 AS score, cast((event_id * 91) % 1000 AS double) / 1000 AS percentile, '2026-02-01' AS observed_at, event_id
FROM {events} WHERE event_id % 3 <> 0""",
    "v_threat_feed": """
SELECT CASE WHEN event_id % 90 = 4 THEN 'cve-' || cast(event_id AS string) ELSE vulnerability_key END AS vulnerability_key, CASE WHEN event_id % 50 = 1 THEN 1.5 WHEN event_id % 60 = 2 THEN NULL ELSE score END AS score,
  CASE WHEN event_id % 70 = 2 THEN -0.1 ELSE percentile END AS percentile FROM {v_threat}""",
    "v_identifiers_shared": """
SELECT identifier, vulnerability_key FROM {v_identifiers} UNION ALL SELECT identifier, 'OTHER-' || substr(md5(identifier), 2, 1) FROM {v_identifiers} WHERE substr(md5(identifier), 1, 1) = '0'""",
    "v_threat_new": """
SELECT 'CVE-2024-' || CASE WHEN event_id < 100000 THEN lpad(cast(event_id AS string), 5, '0') ELSE cast(event_id AS string) END AS vulnerability_key,
  CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE cast((event_id * 37) % 1000 AS double) / 1000 END AS score, cast((event_id * 91) % 1000 AS double) / 1000 AS percentile
FROM {events} WHERE event_id % 4 <> 0""",
    "v_components": """
SELECT 'C-' || cast(p_partkey AS string) AS component_id, 'S-' || cast(p_partkey % 5 AS string) AS sbom_id, package AS name,
  CASE WHEN p_partkey % 50 = 7 THEN 'c0ffee' || cast(p_partkey % 9 AS string) ELSE cast(p_size % 9 + 1 AS string) || '.2' END AS version,
  CASE WHEN p_partkey % 4 = 0 THEN 'pkg:npm/' || package END AS purl,
  CASE WHEN p_partkey % 4 = 1 THEN 'cpe:2.3:a:vendor' || cast(p_partkey % 3 AS string) || ':' || package || ':*:*:*:*:*:*:*:*' END AS cpe23_uri,
  CASE WHEN p_partkey % 4 = 2 THEN package END AS source_package_name,
  CASE WHEN p_partkey % 4 = 1 THEN package END AS cpe_product,
  CASE p_partkey % 3 WHEN 0 THEN 'debian' WHEN 1 THEN 'npm' ELSE NULL END AS ecosystem
FROM (SELECT *, 'pkg-' || cast(CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE p_partkey END AS string) AS package FROM {part})""",
}

_NAME = re.compile(r"\{([a-z]\w*)\}")


def _needed(text: str, found: dict[str, None] | None = None) -> dict[str, None]:
    """Names of views a SQL text uses, inner ones first."""
    found = {} if found is None else found
    for name in _NAME.findall(text):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found[name] = None
    return found


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view, or the table of that name."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    inputs = {inner: view(spark, sf_dir, inner) for inner in dict.fromkeys(_NAME.findall(VIEWS[name]))}
    return spark.sql(VIEWS[name], **inputs)


def oracle(sql: str) -> str:
    """A SQL text with its views as common table expressions."""
    plain = lambda text: _NAME.sub(r"\1", text)
    heads = [f"{name} AS ({plain(VIEWS[name])})" for name in _needed(sql)]
    body = plain(sql).strip()
    if not heads:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(heads) + ",\n" + body[5:]
    return "WITH " + ",\n".join(heads) + "\n" + body
