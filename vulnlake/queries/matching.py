"""Bill-of-material matching and scalar functions over the domain views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions import identity as I
from vulnlake.functions import packages as P
from vulnlake.functions import severity as V
from vulnlake.functions import text as X
from vulnlake.functions.versions import is_commit_like_column, with_version_match
from vulnlake.operators import catalog as C
from vulnlake.operators import quality as Q
from vulnlake.operators import sbom as B
from vulnlake.plans.domain import oracle, view
from vulnlake.queries.catalog import CATALOG, COMPONENTS, _catalog


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return B.candidate_matches(view(spark, d, "v_components"), _catalog(spark, d)[1])


def _bills(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Components of bills, and the affected side without the grouping that only a list of it needs."""
    keys = C.record_rollup(view(spark, d, "v_records")).select(F.col("vulnerability_id").alias("id"), F.col("vulnerability_key").alias("primary_identifier"))
    return view(spark, d, "v_components"), C.affected_facts(view(spark, d, "v_facts"), keys)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the catalog that an export shows, without its other roll-ups."""
    return C.scored_rollup(view(spark, d, "v_records"), view(spark, d, "v_severity"))


def _ordered(spark: SparkSession, d: str, version: str, bounds: str, ecosystem: str) -> DataFrame:
    """Versions made from the facts, against one bound of their ecosystem."""
    made = view(spark, d, "v_facts").withColumns({"version": F.expr(version), "bounds": F.lit(bounds), "eco": F.lit(ecosystem)})
    return with_version_match(made, "version", "bounds", "eco").select("raw_index_id", "line", "version_matched")


CANDIDATE = ["sbom_id", "component_id", "vulnerability_id", "match_basis", "normalized_range"]
QUERIES = {
    "j10_candidate_matches": lambda s, d: _candidates(s, d).select(*CANDIDATE),
    "j11_purl_matches": lambda s, d: B.purl_matches(view(s, d, "v_components").where("purl is not null"), _catalog(s, d)[1]).select(*CANDIDATE),
    "f27_evaluate_matches": lambda s, d: B.evaluated_bills(*_bills(s, d)).select(*CANDIDATE, "version_matched"),
    "d10_best_matches": lambda s, d: B.best_of_bills(*_bills(s, d)).select("sbom_id", "component_id", "vulnerability_id", "match_id", "match_basis", "version_matched"),
    "d09_distinct_components": lambda s, d: B.distinct_components(view(s, d, "v_components")).select("purl", "cpe23_uri", "name", "version", "ecosystem"),
    "a17_sbom_counters": lambda s, d: B.sbom_counters(view(s, d, "v_components"), _candidates(s, d).select("sbom_id", "component_id", "vulnerability_id").distinct())[0],
    "a17_sbom_totals": lambda s, d: B.sbom_counters(view(s, d, "v_components"), _candidates(s, d))[1],
    "a27_sbom_quality": lambda s, d: Q.sbom_quality(B.counted_bills(*_bills(s, d))),
    "t06_findings": lambda s, d: B.findings(_candidates(s, d).select("sbom_id", "component_id", "vulnerability_id").distinct(), _catalog(s, d)[0], "S-1", 500).select("component_id", "primary_identifier", "max_cvss_score"),
    "s17_export_rows": lambda s, d: B.export_rows(*_bills(s, d), _scored(s, d), view(s, d, "v_weaknesses"), view(s, d, "v_references")),
    "f20_version_matches": lambda s, d: with_version_match(view(s, d, "v_facts").withColumn("version", F.expr("cast(line as string) || '.2'")), "version", "version_range_raw", "ecosystem").select("raw_index_id", "line", "version_matched"),
    "f22_debian_order": lambda s, d: _ordered(s, d, "cast(line % 2 as string) || ':' || cast(line as string) || '.0-' || cast(length(raw_index_id) as string)", "< 1:4.0-9", "debian:12"),
    "f23_rpm_order": lambda s, d: _ordered(s, d, "cast(line as string) || CASE WHEN line % 2 = 0 THEN '.0~rc1-1' ELSE '.0-' || cast(length(raw_index_id) as string) END || '.el9'", "< 4.0-9.el9", "rpm"),
    "f24_apk_order": lambda s, d: _ordered(s, d, "cast(line as string) || '.2-r' || cast(length(raw_index_id) as string)", "< 4.2-r9", "alpine:3.20"),
    "f26_commit_like": lambda s, d: view(s, d, "v_records").select("record_no", is_commit_like_column(F.substring("record_hash", 1, 12)).alias("is_commit")),
    "f01_normalize": lambda s, d: view(s, d, "source_records").select("record_no", I.normalize(F.col("vulnerability_key")).alias("norm"), I.is_cve(F.col("vulnerability_key")).alias("is_cve")),
    "f02_valid_identifiers": lambda s, d: view(s, d, "source_record_identifiers").select("identifier", I.is_vulnerability_id(F.col("identifier")).alias("is_valid")).distinct(),
    "f03_embedded_cve": lambda s, d: view(s, d, "v_identifiers").select(F.concat(F.lit("UBUNTU-"), "identifier").alias("identifier")).distinct().withColumn("cve", I.embedded_cve(F.col("identifier"))),
    "f04_resolve_canonical": lambda s, d: view(s, d, "v_identifiers").groupBy("source_code", "source_record_id").agg(F.sort_array(F.collect_set("identifier")).alias("ids")).withColumn("canonical", I.resolve_canonical(F.col("source_record_id"), F.col("ids"))).drop("ids"),
    "f05_vulnerability_guid": lambda s, d: view(s, d, "v_records").select("vulnerability_key").distinct().withColumn("guid", I.vulnerability_guid(F.col("vulnerability_key"))),
    "f06_identifier_type": lambda s, d: view(s, d, "v_identifiers").groupBy(I.identifier_type(F.col("identifier")).alias("kind")).agg(F.count("*").alias("n")),
    "f07_purl_without_version": lambda s, d: view(s, d, "v_facts").select("purl").distinct().withColumn("plain", P.purl_without_version(F.concat("purl", F.lit("?arch=x#sub")))),
    "f08_purl_ecosystem": lambda s, d: view(s, d, "v_facts").select(F.concat(F.lit("pkg:deb/debian/"), "package_name", F.lit("@1?arch=a&distro=debian-12")).alias("purl")).distinct().withColumn("eco", P.purl_ecosystem(F.col("purl"))),
    "f11_to_purl": lambda s, d: view(s, d, "v_facts").select("ecosystem", "package_name").distinct().withColumn("purl", P.to_purl(F.col("ecosystem"), F.col("package_name"))),
    "f15_parse_cpe": lambda s, d: view(s, d, "v_facts").select("cpe23_uri").distinct().select("cpe23_uri", P.parse_cpe(F.col("cpe23_uri"))["vendor"].alias("vendor"), P.cpe_product(F.col("cpe23_uri")).alias("product")),
    "f30_cvss_scores": lambda s, d: V.with_cvss_score(view(s, d, "v_severity").select("vector_string", "scoring_version").distinct(), "vector_string", "scoring_version"),
    "f31_severity_from_score": lambda s, d: view(s, d, "v_severity").select("score", "scoring_version").distinct().withColumn("label", V.severity_from_score(F.col("score"), F.col("scoring_version"))),
    "f36_extract_cves": lambda s, d: view(s, d, "documents").select("doc_id", F.array_join(F.sort_array(X.extract_cves(F.col("text"))), ",").alias("cves")),
    "f37_exploit_class": lambda s, d: view(s, d, "source_records").select("record_no", X.exploit_class(F.concat_ws(" ", "title", "description")).alias("exploit_class")),
    "f42_split_products": lambda s, d: view(s, d, "source_records").select("record_no", F.size(X.split_products(F.coalesce("description", F.lit("")))).cast("bigint").alias("parts")),
    "f46_url_domain": lambda s, d: view(s, d, "v_records").select("record_no", X.url_domain(F.col("source_url")).alias("domain")),
    "f54_source_group": lambda s, d: view(s, d, "v_records").groupBy(X.source_group(F.col("source_code")).alias("source_group")).agg(F.count("*").alias("n")),
}

MATCHES = """SELECT DISTINCT sbom_id, component_id, vulnerability_id, match_basis, normalized_range, version, cpe23_uri, ecosystem, a_cpe, range_type FROM (
SELECT s.*EXCLUDE (ecosystem), a.vulnerability_id, 'cpe-exact' AS match_basis, a.normalized_range, a.ecosystem, a.cpe23_uri AS a_cpe, a.range_type FROM s JOIN a ON s.cpe23_uri = a.cpe23_uri
UNION ALL SELECT s.*EXCLUDE (ecosystem), a.vulnerability_id, 'purl', a.normalized_range, a.ecosystem, a.cpe23_uri, a.range_type FROM s JOIN a ON s.purl = regexp_replace(a.purl, '@[^/@]*$', '')
UNION ALL SELECT s.*EXCLUDE (ecosystem), a.vulnerability_id, 'source-package', a.normalized_range, a.ecosystem, a.cpe23_uri, a.range_type FROM s JOIN a ON lower(s.source_package_name) = lower(a.package_name) AND ECO
UNION ALL SELECT s.*EXCLUDE (ecosystem), a.vulnerability_id, 'display-name', a.normalized_range, a.ecosystem, a.cpe23_uri, a.range_type FROM s JOIN a ON lower(s.name) = lower(a.display_name) AND ECO WHERE s.purl IS NULL AND s.cpe23_uri IS NULL AND s.source_package_name IS NULL
UNION ALL SELECT s.*EXCLUDE (ecosystem), a.vulnerability_id, 'package-name', a.normalized_range, a.ecosystem, a.cpe23_uri, a.range_type FROM s JOIN a ON lower(s.name) = lower(a.package_name) AND ECO WHERE s.purl IS NULL AND s.cpe23_uri IS NULL AND s.source_package_name IS NULL
UNION ALL SELECT s.*EXCLUDE (ecosystem), a.vulnerability_id, 'cpe-product', a.normalized_range, a.ecosystem, a.cpe23_uri, a.range_type FROM s JOIN a ON lower(s.cpe_product) = lower(a.package_name) AND lower(a.ecosystem) = 'cpe' WHERE s.cpe23_uri IS NOT NULL)"""
MATCHES = MATCHES.replace("ECO", "(s.ecosystem IS NULL OR lower(a.ecosystem) = lower(s.ecosystem) OR (NOT contains(s.ecosystem, ':') AND starts_with(lower(a.ecosystem), lower(s.ecosystem) || ':')))")
HEAD = f"WITH a AS ({COMPONENTS}), s AS (SELECT * FROM {{v_components}}), m AS ({MATCHES}) "
# What a match is judged by: of the rows of one component, vulnerability, range and basis, the least by range type, ecosystem and CPE name.
JUDGED = """SELECT sbom_id, component_id, vulnerability_id, match_basis AS basis, normalized_range, min(version) AS version, min(cpe23_uri) AS cpe,
  nullif(min(coalesce(ecosystem, '')) FILTER (WHERE first), '') AS a_ecosystem, nullif(min(coalesce(a_cpe, '')) FILTER (WHERE first), '') AS a_cpe FROM (
  SELECT *, row_number() OVER (PARTITION BY sbom_id, component_id, vulnerability_id, match_basis, normalized_range ORDER BY coalesce(range_type, ''), coalesce(ecosystem, ''), coalesce(a_cpe, '')) = 1 AS first FROM m) GROUP BY 1, 2, 3, 4, 5"""
IS_COMMIT = "regexp_full_match(version, '[0-9a-f]{7,40}')"
MAJOR = "cast(split_part(version, '.', 1) AS INTEGER)"
RANGE_HOLDS = f"""CASE WHEN normalized_range = 'all versions' OR {IS_COMMIT} THEN NULL WHEN normalized_range = '>= 0' THEN true
  ELSE {MAJOR} >= cast(regexp_extract(normalized_range, '>= ([0-9]+)', 1) AS INTEGER) AND {MAJOR} <= cast(regexp_extract(normalized_range, '< ([0-9]+)', 1) AS INTEGER) END"""
SAME_CPE = "CASE WHEN cpe IS NOT NULL AND a_cpe IS NOT NULL THEN split_part(cpe, ':', 4) = split_part(a_cpe, ':', 4) AND split_part(cpe, ':', 5) = split_part(a_cpe, ':', 5) END"
EVALUATED = f"""SELECT *, CASE WHEN hit IS NULL AND coalesce(normalized_range, '') <> '' AND {IS_COMMIT} AND basis IN ('purl', 'source-package', 'cpe-exact') THEN 'possible-' || basis ELSE basis END AS match_basis, hit AS version_matched
FROM (SELECT *, CASE WHEN coalesce(normalized_range, '') <> '' THEN {RANGE_HOLDS} ELSE {SAME_CPE} END AS hit FROM j)"""
RANK = "list_position(['cpe-exact', 'purl', 'source-package', 'display-name', 'package-name', 'cpe-product'], basis)"
BEST = f"""SELECT sbom_id, component_id, vulnerability_id, md5(component_id || '|' || vulnerability_id) AS match_id, match_basis, version_matched, normalized_range FROM (
  SELECT *, row_number() OVER (PARTITION BY sbom_id, component_id, vulnerability_id ORDER BY CASE WHEN version_matched THEN 0 ELSE 1 END, {RANK}, length(coalesce(normalized_range, '')), coalesce(normalized_range, ''), match_basis) AS rn
  FROM e WHERE coalesce(version_matched, true)) WHERE rn = 1"""
DECIDED = HEAD.rstrip() + f", j AS ({JUDGED}), e AS ({EVALUATED}), b AS ({BEST}) "
CELL = lambda c: f"'<td>' || replace(replace(replace(replace(replace(coalesce(cast({c} AS VARCHAR), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;') || '</td>'"
CELLS = " || ".join(map(CELL, ["s.name", "s.version", "s.ecosystem", "s.purl", "f.vulnerability_key", "f.title", "f.severity_label", "f.max_cvss_score", "f.normalized_range", "f.version_matched", "f.match_basis", "f.cwes", "f.urls"]))
PAIRS = HEAD + "SELECT DISTINCT sbom_id, component_id, vulnerability_id FROM m"
BASIC = ", ".join(CANDIDATE)
DIGEST = "sha256('vulnerability:' || vulnerability_key)"
_SQL = {
    "j10_candidate_matches": HEAD + f"SELECT DISTINCT {BASIC} FROM m",
    "j11_purl_matches": HEAD + f"SELECT DISTINCT {BASIC} FROM m WHERE match_basis = 'purl'",
    "d09_distinct_components": "SELECT DISTINCT purl, cpe23_uri, name, version, ecosystem FROM {v_components} WHERE coalesce(purl, '') <> '' OR coalesce(cpe23_uri, '') <> ''",
    "a17_sbom_counters": HEAD + "SELECT s.sbom_id, s.component_id, cast(count(x.vulnerability_id) AS INTEGER) AS vuln_count FROM s LEFT JOIN (SELECT DISTINCT component_id, vulnerability_id FROM m) x ON s.component_id = x.component_id GROUP BY 1, 2",
    "a17_sbom_totals": HEAD + "SELECT s.sbom_id, count(DISTINCT m.vulnerability_id) AS matched_count FROM s LEFT JOIN m ON s.sbom_id = m.sbom_id GROUP BY 1",
    "t06_findings": HEAD + f"SELECT x.component_id, c.primary_identifier, c.max_cvss_score FROM (SELECT DISTINCT sbom_id, component_id, vulnerability_id FROM m WHERE sbom_id = 'S-1') x JOIN ({CATALOG}) c ON x.vulnerability_id = c.id ORDER BY c.max_cvss_score DESC NULLS LAST, c.primary_identifier, x.component_id LIMIT 500",
    "f27_evaluate_matches": DECIDED + f"SELECT {BASIC}, version_matched FROM e",
    "d10_best_matches": DECIDED + "SELECT sbom_id, component_id, vulnerability_id, match_id, match_basis, version_matched FROM b",
    "a27_sbom_quality": DECIDED + """SELECT coalesce(lower(a_ecosystem), 'unknown') AS ecosystem, count(*) AS findings, cast(count_if(version_matched) AS BIGINT) AS affected, cast(count_if(NOT version_matched) AS BIGINT) AS not_affected,
  cast(count_if(version_matched IS NULL) AS BIGINT) AS unknown, cast(count_if(coalesce(normalized_range, '') = '') AS BIGINT) AS no_range, count(DISTINCT component_id) AS components_with_findings,
  round_even((count(*) - count_if(coalesce(normalized_range, '') = '')) / count(*), 4) AS actionable_range_ratio FROM e GROUP BY 1""",
    "s17_export_rows": DECIDED + f""", c AS ({CATALOG}), f AS (SELECT b.*, c.primary_identifier AS vulnerability_key, c.title, c.severity_label, c.max_cvss_score, w.cwes, u.urls FROM b JOIN c ON b.vulnerability_id = c.id
  LEFT JOIN (SELECT vulnerability_key, coalesce(string_agg(DISTINCT weakness_id, ', ' ORDER BY weakness_id), '') AS cwes FROM {{v_weaknesses}} GROUP BY 1) w ON c.primary_identifier = w.vulnerability_key
  LEFT JOIN (SELECT vulnerability_key, string_agg(DISTINCT url, ', ' ORDER BY url) AS urls FROM {{v_references}} GROUP BY 1) u ON c.primary_identifier = u.vulnerability_key)
SELECT s.sbom_id, s.component_id, f.vulnerability_key, '<tr>' || {CELLS} || '</tr>' AS html_row FROM s LEFT JOIN f ON s.component_id = f.component_id""",
    "f26_commit_like": "SELECT record_no, coalesce(regexp_full_match(lower(substr(record_hash, 1, 12)), '[0-9a-f]{7,40}'), false) AS is_commit FROM {v_records}",
    "f01_normalize": "SELECT record_no, upper(trim(vulnerability_key, ' 	')) AS norm, coalesce(regexp_full_match(upper(trim(vulnerability_key, ' 	')), 'CVE-[0-9]{4}-[0-9]{4,}'), false) AS is_cve FROM {source_records}",
    "f02_valid_identifiers": """SELECT DISTINCT identifier, coalesce(length(trim(identifier, ' 	')) BETWEEN 4 AND 160 AND CASE WHEN starts_with(upper(trim(identifier, ' 	')), 'CVE-') THEN regexp_full_match(upper(trim(identifier, ' 	')), 'CVE-[0-9]{4}-[0-9]{4,}')
  ELSE regexp_full_match(upper(trim(identifier, ' 	')), '[A-Z][A-Z0-9_.]*-[A-Z0-9][A-Z0-9_.:-]*') END, false) AS is_valid FROM {source_record_identifiers}""",
    "f03_embedded_cve": "SELECT DISTINCT 'UBUNTU-' || identifier AS identifier, nullif(regexp_extract('UBUNTU-' || identifier, '^[A-Z][A-Z0-9_.-]*-(CVE-[0-9]{4}-[0-9]{4,})$', 1), '') AS cve FROM {v_identifiers}",
    "f04_resolve_canonical": """SELECT source_code, source_record_id, CASE WHEN len(c) = 1 THEN c[1] WHEN len(c) > 1 OR starts_with(own, 'GHSA-') THEN own WHEN len(g) = 1 THEN g[1] ELSE own END AS canonical
FROM (SELECT source_code, source_record_id, upper(trim(source_record_id)) AS own, coalesce(list(DISTINCT identifier) FILTER (WHERE regexp_full_match(identifier, 'CVE-[0-9]{4}-[0-9]{4,}')), []) AS c,
  coalesce(list(DISTINCT identifier) FILTER (WHERE starts_with(identifier, 'GHSA-')), []) AS g FROM {v_identifiers} GROUP BY 1, 2)""",
    "f20_version_matches": """SELECT raw_index_id, line, CASE WHEN coalesce(version_range_raw, '') IN ('', 'all versions') THEN NULL WHEN version_range_raw = '>= 0' THEN true
  ELSE line <= cast(regexp_extract(version_range_raw, '< ([0-9]+)[.]5', 1) AS INTEGER) END AS version_matched FROM {v_facts}""",
    "f05_vulnerability_guid": f"""SELECT vulnerability_key, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || '5' || substr(h, 14, 1) || '-' ||
  substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 1) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS guid FROM (SELECT DISTINCT vulnerability_key, {DIGEST} AS h FROM {{v_records}})""",
    "f06_identifier_type": """SELECT CASE WHEN split_part(identifier, '-', 1) IN ('CVE', 'GHSA', 'PYSEC', 'RUSTSEC', 'ASB', 'OSV', 'UBUNTU', 'CNNVD', 'CNVD', 'SSV', 'AVD', 'CT', 'NSFOCUS', 'CERT360') AND contains(identifier, '-')
  THEN split_part(identifier, '-', 1) WHEN regexp_full_match(identifier, 'CWE-[0-9]+') THEN 'CWE' ELSE 'OTHER' END AS kind, count(*) AS n FROM {v_identifiers} GROUP BY 1""",
    "f07_purl_without_version": "SELECT DISTINCT purl, regexp_replace(purl, '@[^/@]*$', '') AS plain FROM {v_facts}",
    "f08_purl_ecosystem": "SELECT DISTINCT 'pkg:deb/debian/' || package_name || '@1?arch=a&distro=debian-12' AS purl, 'debian:12' AS eco FROM {v_facts}",
    "f11_to_purl": """SELECT DISTINCT ecosystem, package_name, CASE WHEN package_name = '' THEN NULL WHEN ecosystem = 'npm' THEN 'pkg:npm/' || package_name WHEN ecosystem = 'pypi' THEN 'pkg:pypi/' || lower(package_name) END AS purl FROM {v_facts}""",
    "f15_parse_cpe": "SELECT DISTINCT cpe23_uri, split_part(cpe23_uri, ':', 4) AS vendor, split_part(cpe23_uri, ':', 5) AS product FROM {v_facts}",
    "f30_cvss_scores": """SELECT DISTINCT vector_string, scoring_version, CASE WHEN vector_string LIKE 'AV:%/A:P' THEN 7.5 WHEN vector_string LIKE 'AV:%/A:N' THEN 6.4 WHEN vector_string LIKE '%UI:R%/A:H' THEN 8.8
  WHEN vector_string LIKE '%UI:R%/A:N' THEN 8.1 WHEN vector_string LIKE '%/A:H' THEN 9.8 WHEN vector_string LIKE '%/A:N' THEN 9.1 END::DOUBLE AS base_score FROM {v_severity}""",
    "f22_debian_order": """SELECT raw_index_id, line, (line % 2, line, length(raw_index_id)) < (1, 4, 9) AS version_matched FROM {v_facts}""",
    "f23_rpm_order": "SELECT raw_index_id, line, CASE WHEN line % 2 = 0 THEN line <= 4 ELSE line < 4 OR (line = 4 AND length(raw_index_id) < 9) END AS version_matched FROM {v_facts}",
    "f24_apk_order": "SELECT raw_index_id, line, (line, length(raw_index_id)) < (4, 9) AS version_matched FROM {v_facts}",
    "f31_severity_from_score": """SELECT DISTINCT score, scoring_version, CASE WHEN score IS NULL THEN NULL WHEN scoring_version LIKE '2%' THEN CASE WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' ELSE 'LOW' END
  WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'NONE' END AS label FROM {v_severity}""",
    "f36_extract_cves": "SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct([upper(x) for x in regexp_extract_all(text, '(?i)\\bCVE-[0-9]{4}-[0-9]{4,}\\b')])), ','), '') AS cves FROM {documents}",
    "f37_exploit_class": """SELECT record_no, CASE WHEN regexp_matches(t, '\\brce\\b|remote code execution|command execution|code injection') THEN 'rce' WHEN regexp_matches(t, 'privilege escalation|\\blpe\\b|local root|local privilege') THEN 'lpe'
  WHEN regexp_matches(t, 'auth bypass|authentication bypass|unauthenticated|authorization bypass') THEN 'auth_bypass' WHEN regexp_matches(t, 'sql injection|\\bsqli\\b') THEN 'sqli' WHEN regexp_matches(t, 'cross.?site scripting|\\bxss\\b') THEN 'xss'
  WHEN regexp_matches(t, 'information disclosure|info.?leak|file disclosure|arbitrary file read') THEN 'infoleak' WHEN regexp_matches(t, 'denial of service|\\bdos\\b|crash') THEN 'dos' END AS exploit_class
FROM (SELECT record_no, lower(concat_ws(' ', title, description)) AS t FROM {source_records})""",
    "f42_split_products": "SELECT record_no, len(list_distinct([trim(x) for x in regexp_split_to_array(coalesce(description, ''), '[\\r\\n,，;；|]+') if trim(x) <> ''])) AS parts FROM {source_records}",
    "f46_url_domain": "SELECT record_no, nullif(lower(regexp_extract(source_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '') AS domain FROM {v_records}",
    "f54_source_group": """SELECT CASE WHEN source_code IN ('exploitdb', 'metasploit', 'nuclei-templates', 'poc-in-github', 'trickest-cve', 'seebug') THEN 'exploit' WHEN source_code IN ('cnnvd', 'cnvd', 'aliyun-avd', 'cert-360', 'chaitin-vuldb', 'nsfocus-vulndb') THEN 'domestic'
  WHEN source_code IN ('cisa-kev', 'first-epss') THEN 'threat' WHEN source_code IN ('debian-security-tracker', 'alpine-secdb', 'redhat-csaf', 'suse-csaf', 'ubuntu-osv') THEN 'distribution' ELSE 'advisory' END AS source_group, count(*) AS n FROM {v_records} GROUP BY 1""",
}
SQL = {name: oracle(sql) for name, sql in _SQL.items()}
