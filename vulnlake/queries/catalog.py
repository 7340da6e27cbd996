"""Catalog, projections and search over the domain views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.operators import catalog as C
from vulnlake.plans import search as S
from vulnlake.plans.domain import oracle, view


def _v(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [view(spark, d, n) for n in names]


def _catalog(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Catalog and components of the views, as the projections build them."""
    records, identifiers, severity, facts = _v(spark, d, "v_records", "v_identifiers", "v_severity", "v_facts")
    keys = C.record_rollup(records).select(F.col("vulnerability_id").alias("id"), F.col("vulnerability_key").alias("primary_identifier"))
    components = C.affected_components(facts, keys)
    return C.catalog(records, identifiers, severity, components), components


EXPLOIT = "('exploitdb', 'poc-in-github', 'nuclei-templates', 'metasploit', 'trickest-cve', 'seebug')"
SHOWN = "coalesce(normalizer_version, '') <> 'evidence-projection-unlinked-v1'"
CATALOG_ID = "regexp_full_match(identifier, '(CVE-[0-9]{{4}}-[0-9]{{4,}}|[A-Z][A-Z0-9_.]*-[A-Z0-9][A-Z0-9_.:-]*)')".replace("{{", "{").replace("}}", "}")
OWNED = f"source_code NOT IN {EXPLOIT} AND {CATALOG_ID} AND (NOT starts_with(identifier, 'CVE-') OR identifier = vulnerability_key)"
LIVE = f"(source_code, source_record_id) IN (SELECT (source_code, source_record_id) FROM {{v_records}} WHERE {SHOWN})"


def _best(column: str, first: str, second: str, third: str = "3") -> str:
    prio = f"CASE WHEN source_code IN ({first}) THEN 0 {second} WHEN source_code IN {EXPLOIT} THEN 9 ELSE {third} END"
    return (
        f"arg_max({column}, (-({prio}), coalesce(modified_at, published_at, ''), source_record_id, source_code, {column})) "
        f"FILTER (WHERE {column} <> '') AS {column}"
    )


ROLLUP = f"""
SELECT vulnerability_id, vulnerability_key,
  {_best('title', "'ghsa', 'maven-advisory', 'maven-osv', 'osv'", "WHEN source_code IN ('cve-list-v5', 'nvd-cve', 'cisa-kev') THEN 1")},
  {_best('description', "'cve-list-v5', 'nvd-cve'", "WHEN source_code IN ('ghsa', 'maven-advisory', 'maven-osv', 'osv') THEN 1")},
  {_best('status', "'cve-list-v5', 'nvd-cve', 'cisa-kev'", "")},
  min(nullif(published_at, '')) AS published_at, max(nullif(modified_at, '')) AS modified_at, count(*) AS source_count
FROM {{v_records}} WHERE {SHOWN} AND source_code <> 'nuclei-templates' GROUP BY 1, 2"""
SEVERITY = """
SELECT vulnerability_key, max(score) AS max_cvss_score,
  arg_max(severity_label, (score, severity_label)) FILTER (WHERE severity_label IS NOT NULL AND score IS NOT NULL) AS severity_label
FROM {v_severity} GROUP BY 1"""
OWNERS = f"""
SELECT identifier, arg_min(vulnerability_id, (vulnerability_key, vulnerability_id)) AS vulnerability_id, min(vulnerability_key) AS vulnerability_key
FROM {{v_identifiers}} WHERE {OWNED} AND {LIVE} GROUP BY 1"""
IDENTIFIERS = f"""
SELECT vulnerability_key, cast(to_json(list_sort(list(DISTINCT identifier))) AS VARCHAR) AS identifiers_json
FROM {{v_identifiers}} WHERE {OWNED} AND {LIVE} GROUP BY 1"""
NAME = "coalesce(nullif(package_name, ''), nullif(purl, ''), nullif(cpe23_uri, ''), 'unknown')"
COMPONENTS = f"""
SELECT md5(r.vulnerability_id || '|' || source_code || '|' || coalesce(ecosystem, '') || '|' || coalesce(package_name, '') || '|' || coalesce(purl, '') || '|' || coalesce(cpe23_uri, '') || '|' || coalesce(version_range_raw, '')) AS id,
  r.vulnerability_id, source_code, ecosystem, package_name, purl, cpe23_uri, version_range_raw AS normalized_range, range_type, {NAME} AS display_name,
  CASE WHEN cpe23_uri <> '' THEN 1.0 WHEN purl <> '' THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence, cast(count(*) AS INTEGER) AS evidence_count
FROM {{v_facts}} f JOIN (SELECT DISTINCT vulnerability_id, vulnerability_key FROM ({ROLLUP})) r ON f.vulnerability_key = r.vulnerability_key
WHERE vulnerable GROUP BY ALL"""
COMPONENTS = COMPONENTS.replace("GROUP BY ALL", "GROUP BY r.vulnerability_id, source_code, ecosystem, package_name, purl, cpe23_uri, version_range_raw, range_type")
CATALOG = f"""
SELECT r.vulnerability_id AS id, r.vulnerability_key AS primary_identifier, r.title, r.description, r.status, r.published_at, r.modified_at, r.source_count,
  s.max_cvss_score, s.severity_label, coalesce(a.n, 0) AS affected_component_count, coalesce(a.names, '[]') AS affected_component_names_json,
  coalesce(i.identifiers_json, '[]') AS identifiers_json
FROM ({ROLLUP}) r LEFT JOIN ({SEVERITY}) s ON r.vulnerability_key = s.vulnerability_key
LEFT JOIN (SELECT vulnerability_id, count(DISTINCT display_name) AS n, cast(to_json(list_sort(list(DISTINCT display_name))) AS VARCHAR) AS names FROM ({COMPONENTS}) GROUP BY 1) a
  ON r.vulnerability_id = a.vulnerability_id
LEFT JOIN ({IDENTIFIERS}) i ON r.vulnerability_key = i.vulnerability_key"""

COMPONENT_COLUMNS = ["id", "vulnerability_id", "source_code", "ecosystem", "package_name", "purl", "cpe23_uri", "normalized_range", "range_type", "display_name", "confidence", "evidence_count"]


def a01_record_rollup(spark, d):
    return C.record_rollup(view(spark, d, "v_records"))


def a02_severity_rollup(spark, d):
    return C.severity_rollup(view(spark, d, "v_severity"))


def a04_identifier_rollup(spark, d):
    return C.identifier_rollup(*_v(spark, d, "v_identifiers", "v_records"))


def a05_alias_owners(spark, d):
    return C.alias_owners(*_v(spark, d, "v_identifiers", "v_records"))


def a06_affected_components(spark, d):
    return _catalog(spark, d)[1].select(*COMPONENT_COLUMNS)


def a07_components_from_keys(spark, d):
    facts, records = _v(spark, d, "v_facts", "v_records")
    out = C.components_from_keys(facts, records.select("vulnerability_key", "vulnerability_id").distinct())
    return out.select("id", "vulnerability_id", "display_name", "range_type", "evidence_count", "confidence", "resolution_status")


def a08_component_summary(spark, d):
    return C.component_summary(_catalog(spark, d)[1])


def a18_component_catalog(spark, d):
    return C.component_catalog(_catalog(spark, d)[1])


def j01_catalog(spark, d):
    return _catalog(spark, d)[0]


def f35_search_tokens(spark, d):
    return C.search_tokens(_catalog(spark, d)[0])


def t01_latest(spark, d):
    return C.latest(_catalog(spark, d)[0], 500).select("id", "primary_identifier", "title", "modified_at", "max_cvss_score")


def m09_keyed_rebuild_owners(spark, d):
    identifiers, records = _v(spark, d, "v_identifiers", "v_records")
    keys = records.where("record_no % 5 = 0").select("vulnerability_key").distinct()
    stale = C.alias_owners(identifiers.where("source_code <> 'osv'"), records)
    changed = identifiers.where("source_code = 'osv'").select("vulnerability_key").unionByName(keys).distinct()
    return C.rebuild_owners(stale, identifiers, records, changed)


def m09_keyed_rebuild_catalog(spark, d):
    records, identifiers, severity, _ = _v(spark, d, "v_records", "v_identifiers", "v_severity", "v_facts")
    full, components = _catalog(spark, d)
    keys = records.where("record_no % 3 = 0").select("vulnerability_key").distinct()
    # of the changed keys, the stale catalog has old titles, lacks a quarter and has rows whose records are gone
    name = F.col("primary_identifier")
    quarter = F.crc32("vulnerability_key") % 4
    gone = F.concat(F.lit("GONE-"), "vulnerability_key")
    row = lambda key, id, title: F.struct(key.alias("primary_identifier"), id.alias("id"), title.alias("title"))
    old = row(name, F.col("id"), F.concat(F.lit("old "), F.coalesce("title", F.lit(""))))
    rows = F.when(F.col("vulnerability_key").isNull(), F.array(row(name, F.col("id"), F.col("title")))).when(quarter == 1, F.array(old, row(gone, F.md5(gone), F.col("title")))).when(quarter > 1, F.array(old))
    marked = full.join(keys, name == F.col("vulnerability_key"), "left").withColumn("row", F.explode(rows))
    stale = marked.select(*(F.col(f"row.{c}" if c in ("primary_identifier", "id", "title") else c).alias(c) for c in full.columns))
    keys = keys.unionByName(keys.where(quarter == 1).select(gone.alias("vulnerability_key")))
    return C.rebuild_catalog(stale, records, identifiers, severity, components, keys).select(*full.columns)


def p11_year_range(spark, d):
    return _catalog(spark, d)[0].where(S.year_range(2021)).select("primary_identifier", "title")


def p12_substring_search(spark, d):
    vulnerabilities, relations = _catalog(spark, d)[0], view(spark, d, "v_relations")
    return S.substring_search(vulnerabilities, relations, "gateway%race").select("primary_identifier", "title")


def a14_token_search(spark, d):
    vulnerabilities = _catalog(spark, d)[0]
    hits = S.token_hits(C.search_tokens(vulnerabilities), ["sql", "injection"])
    return vulnerabilities.join(hits.withColumnRenamed("vulnerability_id", "id"), "id", "left_semi").select("primary_identifier", "title")


def t02_search_page(spark, d):
    vulnerabilities, relations = _catalog(spark, d)[0], view(spark, d, "v_relations")
    _, page = S.plan_search(vulnerabilities, C.search_tokens(vulnerabilities), relations, None, "cvssDesc", page=2, size=40)
    return page.select("id", "primary_identifier", "max_cvss_score")


def j18_resolve_identifier(spark, d):
    vulnerabilities = _catalog(spark, d)[0]
    identifiers, records, relations = _v(spark, d, "v_identifiers", "v_records", "v_relations")
    wanted = identifiers.select("identifier")
    return S.resolve_identifier(wanted, vulnerabilities, C.alias_owners(identifiers, records), relations)


def j19_component_search(spark, d):
    found = S.component_search(_catalog(spark, d)[1], None, "pkg-7", "debian")
    return found.select("id", "range_type", "display_name", "ecosystem", "tier")


def t07_vulnerabilities_of(spark, d):
    vulnerabilities, components = _catalog(spark, d)
    hits = components.where("display_name_lower = 'pkg-9'")
    return S.vulnerabilities_of(hits, vulnerabilities, 50).select("primary_identifier", "max_cvss_score", "n_components")


NAMES = ["a01_record_rollup", "a02_severity_rollup", "a04_identifier_rollup", "a05_alias_owners", "a06_affected_components", "a07_components_from_keys", "a08_component_summary",
         "a18_component_catalog", "j01_catalog", "f35_search_tokens", "t01_latest", "m09_keyed_rebuild_owners", "m09_keyed_rebuild_catalog", "p11_year_range", "p12_substring_search",
         "a14_token_search", "t02_search_page", "j18_resolve_identifier", "j19_component_search", "t07_vulnerabilities_of"]
QUERIES = {name: globals()[name] for name in NAMES}

TOKENS = f"SELECT DISTINCT id AS vulnerability_id, token FROM (SELECT id, unnest(regexp_split_to_array(lower(concat_ws(' ', primary_identifier, title, identifiers_json)), '[^a-z0-9]+')) AS token FROM ({CATALOG})) WHERE length(token) >= 2"
_SQL = {
    "a01_record_rollup": ROLLUP,
    "a02_severity_rollup": SEVERITY,
    "a04_identifier_rollup": IDENTIFIERS,
    "a05_alias_owners": OWNERS,
    "a06_affected_components": COMPONENTS,
    "a07_components_from_keys": f"""
SELECT md5(concat_ws('|', k.vulnerability_id, coalesce(ecosystem, ''), coalesce(package_name, ''), coalesce(purl, ''), coalesce(cpe23_uri, ''), coalesce(version_range_raw, ''), coalesce(range_type, ''))) AS id,
  k.vulnerability_id, {NAME} AS display_name, range_type, cast(count(*) AS INTEGER) AS evidence_count, 1.0::DOUBLE AS confidence, 'candidate' AS resolution_status
FROM {{v_facts}} f JOIN (SELECT DISTINCT vulnerability_key, vulnerability_id FROM {{v_records}}) k ON f.vulnerability_key = k.vulnerability_key
WHERE vulnerable AND {NAME} <> 'unknown' GROUP BY k.vulnerability_id, ecosystem, package_name, purl, cpe23_uri, version_range_raw, range_type""",
    "a08_component_summary": f"""
SELECT vulnerability_id, count(*) AS component_count, coalesce(string_agg(DISTINCT nullif(lower(ecosystem), ''), '|' ORDER BY nullif(lower(ecosystem), '')), '') AS ecosystems,
  string_agg(DISTINCT lower(display_name), '|' ORDER BY lower(display_name)) AS names FROM ({COMPONENTS}) GROUP BY 1""",
    "a18_component_catalog": f"""
SELECT ecosystem, display_name, max(purl) AS primary_purl, max(cpe23_uri) AS primary_cpe23_uri, count(DISTINCT vulnerability_id) AS vulnerability_count,
  CASE WHEN max(cpe23_uri) IS NOT NULL AND max(purl) IS NULL THEN 'cpe' ELSE 'package' END AS component_type FROM ({COMPONENTS}) GROUP BY 1, 2""",
    "j01_catalog": CATALOG,
    "f35_search_tokens": TOKENS,
    "t01_latest": f"SELECT id, primary_identifier, title, modified_at, max_cvss_score FROM ({CATALOG}) ORDER BY modified_at DESC NULLS LAST, id DESC LIMIT 500",
    "m09_keyed_rebuild_owners": OWNERS,
    "m09_keyed_rebuild_catalog": CATALOG,
    "p11_year_range": f"SELECT primary_identifier, title FROM ({CATALOG}) WHERE primary_identifier >= 'CVE-2021' AND primary_identifier < 'CVE-2022'",
    "p12_substring_search": f"""
SELECT primary_identifier, title FROM ({CATALOG}) c WHERE lower(primary_identifier) LIKE '%gateway%race%' OR lower(title) LIKE '%gateway%race%' OR lower(identifiers_json) LIKE '%gateway%race%'
  OR EXISTS (SELECT 1 FROM {{v_relations}} r WHERE r.vulnerability_id = c.id AND lower(related_identifier) LIKE '%gateway%race%')""",
    "a14_token_search": f"""
SELECT primary_identifier, title FROM ({CATALOG}) WHERE id IN
  (SELECT vulnerability_id FROM ({TOKENS}) WHERE token IN ('sql', 'injection') GROUP BY 1 HAVING count(DISTINCT token) = 2)""",
    "t02_search_page": f"SELECT id, primary_identifier, max_cvss_score FROM ({CATALOG}) ORDER BY max_cvss_score DESC NULLS LAST, id DESC LIMIT 41 OFFSET 40",
    "j18_resolve_identifier": f"""
WITH asked AS (SELECT DISTINCT identifier FROM {{v_identifiers}}), cat AS ({CATALOG}), own AS ({OWNERS}), tiers AS (
  SELECT a.identifier, c.id, 0 AS tier FROM asked a JOIN cat c ON a.identifier = c.primary_identifier
  UNION ALL SELECT a.identifier, o.vulnerability_id, 1 FROM asked a JOIN own o ON a.identifier = o.identifier
  UNION ALL SELECT a.identifier, r.vulnerability_id, CASE WHEN relation_type = 'upstream' THEN 2 ELSE 3 END FROM asked a JOIN {{v_relations}} r ON a.identifier = r.related_identifier)
SELECT t.identifier, cast(min(t.tier) AS BIGINT) AS tier, arg_min(c.primary_identifier, (t.tier, c.primary_identifier, c.id)) AS primary_identifier, arg_min(c.id, (t.tier, c.primary_identifier, c.id)) AS id
FROM tiers t JOIN cat c ON t.id = c.id GROUP BY 1""",
    "j19_component_search": f"""
WITH t AS (SELECT *, CASE WHEN lower(display_name) = 'pkg-7' AND (lower(ecosystem) = 'debian' OR starts_with(lower(ecosystem), 'debian:')) THEN 1
  WHEN lower(concat_ws(chr(10), display_name, package_name, purl, cpe23_uri)) LIKE '%pkg-7%' THEN 2 END AS tier FROM ({COMPONENTS}))
SELECT id, range_type, display_name, ecosystem, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""",
    "t07_vulnerabilities_of": f"""
SELECT c.primary_identifier, c.max_cvss_score, h.n_components FROM (SELECT vulnerability_id, count(*) AS n_components FROM ({COMPONENTS}) WHERE lower(display_name) = 'pkg-9' GROUP BY 1) h
JOIN ({CATALOG}) c ON h.vulnerability_id = c.id ORDER BY coalesce(c.max_cvss_score, 0.0) DESC, lower(c.primary_identifier), c.id LIMIT 50""",
}
SQL = {name: oracle(sql) for name, sql in _SQL.items()}
