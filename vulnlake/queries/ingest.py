"""Normalisation of spool lines, cursors and display rows over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.operators import bundles as U
from vulnlake.operators import normalize as N
from vulnlake.plans.domain import oracle, view
from vulnlake.queries.catalog import _catalog
from vulnlake.streaming.drain import after_cursor


def _osv_lines(spark: SparkSession, d: str) -> DataFrame:
    """One OSV line per record: its key as the alias, one event range by number."""
    r = view(spark, d, "v_records")
    event = lambda name, value: F.create_map(F.lit(name), value)
    low, high = (F.col("record_no") % 7).cast("string"), (F.col("record_no") % 9 + 1).cast("string")
    events = F.array(event("introduced", low), F.when(F.col("record_no") % 2 == 0, event("fixed", high)).otherwise(event("last_affected", high)))
    package = F.struct(F.lit("npm").alias("ecosystem"), F.concat(F.lit("pkg-"), "record_no").alias("name"))
    affected = F.array(F.struct(package.alias("package"), F.array(F.struct(F.lit("SEMVER").alias("type"), events.alias("events"))).alias("ranges")))
    payload = F.struct(
        F.concat(F.lit("OSV-X-"), "record_no").alias("id"), F.array("vulnerability_key").alias("aliases"), F.col("title").alias("summary"), affected.alias("affected"),
        F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H").alias("score"))).alias("severity"), F.array("source_url").alias("references"),
    )
    line = F.struct(F.lit("osv").alias("sourceCode"), F.col("record_no").cast("string").alias("externalKey"), payload["id"].alias("externalId"), F.col("record_hash").alias("recordHash"), payload.alias("payload"))
    return r.select(F.to_json(line).alias("value"))


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    return N.normalize_envelopes(N.parse_envelopes(_osv_lines(spark, d)))


def _lines(spark: SparkSession, d: str, source: str, key: str, payload) -> DataFrame:
    """One spool line of a source per record."""
    head = {"sourceCode": F.lit(source), "externalKey": F.expr(key), "externalId": F.expr(key), "recordHash": F.col("record_hash"), "payload": payload}
    lines = view(spark, d, "v_records").select(F.to_json(F.struct(*(value.alias(name) for name, value in head.items()))).alias("value"))
    return N.normalize_envelopes(N.parse_envelopes(lines))


_s = lambda **fields: F.struct(*(value.alias(name) for name, value in fields.items()))
_n = lambda: F.col("record_no")
_t = lambda expression: F.expr(f"cast({expression} as string)")
CVE_KEY = "'CVE-2030-' || cast(10000 + record_no as string)"


def _nvd(spark: SparkSession, d: str) -> DataFrame:
    match = _s(criteria=F.expr("'cpe:2.3:a:v' || cast(record_no % 9 as string) || ':p' || cast(record_no as string) || ':*:*:*:*:*:*:*:*'"), versionStartIncluding=F.when(_n() % 2 == 0, _t("record_no % 7")), versionEndExcluding=_t("record_no % 9 + 1"))
    inner = _s(cpeMatch=F.array(_s(criteria=F.expr("'cpe:2.3:o:os:q' || cast(record_no as string) || ':*:*:*:*:*:*:*:*'"), vulnerable=F.lit(False))))
    texts = F.array(_s(lang=F.lit("fr"), value=F.lit("autre")), _s(lang=F.lit("en"), value=F.col("title")))
    cve = _s(id=F.expr(CVE_KEY), vulnStatus=F.col("status"), published=F.col("published_at"), descriptions=texts, configurations=F.array(_s(nodes=F.array(_s(cpeMatch=F.array(match), nodes=F.array(inner))))))
    return _lines(spark, d, "nvd-cve", CVE_KEY, _s(cve=cve))


def _ghsa(spark: SparkSession, d: str) -> DataFrame:
    package = _s(ecosystem=F.lit("npm"), name=F.expr("'pkg-' || cast(record_no as string)"))
    return _lines(spark, d, "ghsa", "'GHSA-X-' || cast(record_no as string)", _s(summary=F.col("title"), vulnerabilities=F.array(_s(package=package, vulnerable_version_range=F.concat(F.lit("< "), _t("record_no % 9"))))))


def _cve5(spark: SparkSession, d: str) -> DataFrame:
    version = _s(version=_t("record_no % 7"), status=F.lit("affected"), lessThan=F.when(_n() % 3 == 0, _t("record_no % 7 + 2")), lessThanOrEqual=F.when(_n() % 3 == 1, _t("record_no % 7 + 1")))
    affected = _s(vendor=F.when(_n() % 2 == 0, F.lit("v")), product=F.expr("'p' || cast(record_no as string)"), versions=F.array(version, _s(version=F.lit("0"), status=F.lit("unaffected"), lessThan=F.lit(None).cast("string"), lessThanOrEqual=F.lit(None).cast("string"))))
    return _lines(spark, d, "cve-list-v5", CVE_KEY, _s(cveMetadata=_s(cveId=F.expr(CVE_KEY), state=F.lit("PUBLISHED")), containers=_s(cna=_s(title=F.col("title"), affected=F.array(affected)))))


def _kev(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, "cisa-kev", CVE_KEY, _s(cveID=F.expr(CVE_KEY), vulnerabilityName=F.col("title"), dateAdded=F.lit("2030-01-02")))


def _debian(spark: SparkSession, d: str) -> DataFrame:
    resolved = _s(status=F.lit("resolved"), fixed_version=F.when(_n() % 4 == 0, F.lit("0")).otherwise(F.concat(F.lit("1."), _t("record_no"))))
    state = lambda word: _s(status=F.lit(word), fixed_version=F.lit(None).cast("string"))
    releases = F.create_map(F.lit("bookworm"), resolved, F.lit("bullseye"), state("open"), F.lit("sid"), state("undetermined"))
    return _lines(spark, d, "debian-security-tracker", CVE_KEY, _s(packages=F.create_map(F.expr("'pkg-' || cast(record_no as string)"), _s(releases=releases))))


FACT = ["source_record_id", "ecosystem", "package_name", "purl", "cpe23_uri", "version_range_raw", "range_type", "vulnerable"]
QUERIES = {
    "n01_nvd_records": lambda s, d: _nvd(s, d).select("source_code", "source_record_id", "vulnerability_key", "title", "description", "status", "published_at"),
    "n10_nvd_facts": lambda s, d: N.affected_facts(_nvd(s, d)).select(*FACT),
    "n13_ghsa_facts": lambda s, d: N.affected_facts(_ghsa(s, d)).select(*FACT),
    "n12_cve5_facts": lambda s, d: N.affected_facts(_cve5(s, d)).select(*FACT),
    "n05_kev_scores": lambda s, d: N.threat_scores(_kev(s, d)).select("source_code", "vulnerability_key", "score_type", "score", "observed_at"),
    "n14_debian_facts": lambda s, d: N.affected_facts(_debian(s, d)).select(*FACT),
    "n02_osv_records": lambda s, d: _normalized(s, d).select("source_code", "source_record_id", "vulnerability_key", "normalizer_version", "title", "status"),
    "n08_osv_facts": lambda s, d: N.affected_facts(_normalized(s, d)).select("source_record_id", "vulnerability_key", "ecosystem", "package_name", "purl", "version_range_raw", "range_type", "vulnerable"),
    "n16_osv_severity": lambda s, d: N.severity_scores(_normalized(s, d)).select("source_record_id", "scoring_system", "scoring_version", "score", "severity_label"),
    "n17_osv_references": lambda s, d: N.evidence_references(_normalized(s, d)).select("source_record_id", "url", "normalized_url"),
    "d06_record_identifiers": lambda s, d: N.record_identifiers(_normalized(s, d)).select("source_record_id", "identifier"),
    "x03_after_cursor": lambda s, d: after_cursor(view(s, d, "v_records").select("record_no", F.col("modified_at").alias("stamp"), F.col("source_record_id").alias("id")), "2022", ["NVD-1"], "stamp", "id"),
    "n26_evidence_bundles": lambda s, d: U.evidence_bundles(_catalog(s, d)[0], *(view(s, d, v) for v in ("v_facts", "v_severity", "v_references", "v_weaknesses"))).select("vulnerability_key", "input_chars", "evidence_hash"),
    "d13_grouped_descriptions": lambda s, d: U.grouped_descriptions(view(s, d, "v_records")),
    "d15_headlines": lambda s, d: U.headlines(view(s, d, "v_records")),
    "d16_ranked_aliases": lambda s, d: U.ranked_aliases(view(s, d, "v_identifiers")),
    "f52_triaged_references": lambda s, d: U.triaged_references(view(s, d, "v_references")),
    "f53_relation_groups": lambda s, d: U.relation_groups(view(s, d, "v_relations")),
}

OWN = "'OSV-X-' || cast(record_no AS string)"
CVE_ID = "'CVE-2030-' || cast(10000 + record_no AS string)"
NPM = "'pkg-' || cast(record_no AS string)"
PAD = ":*:*:*:*:*:*:*:*"
_SQL = {
    "n01_nvd_records": f"""SELECT 'nvd-cve' AS source_code, {CVE_ID} AS source_record_id, {CVE_ID} AS vulnerability_key, CASE WHEN length(t) <= 220 THEN t END AS title, t AS description, status, published_at
  FROM (SELECT *, CASE WHEN trim(title) <> '' THEN title END AS t FROM {{v_records}})""",
    "n10_nvd_facts": f"""SELECT {CVE_ID} AS source_record_id, 'cpe' AS ecosystem, 'p' || cast(record_no AS string) AS package_name, NULL::VARCHAR AS purl, 'cpe:2.3:a:v' || cast(record_no % 9 AS string) || ':p' || cast(record_no AS string) || '{PAD}' AS cpe23_uri,
  CASE WHEN record_no % 2 = 0 THEN '>= ' || cast(record_no % 7 AS string) || ', ' ELSE '' END || '< ' || cast(record_no % 9 + 1 AS string) AS version_range_raw, 'cpe_match' AS range_type, true AS vulnerable FROM {{v_records}}
  UNION ALL SELECT {CVE_ID}, 'cpe', 'q' || cast(record_no AS string), NULL, 'cpe:2.3:o:os:q' || cast(record_no AS string) || '{PAD}', NULL, 'cpe_match_no_range', false FROM {{v_records}}""",
    "n13_ghsa_facts": f"SELECT 'GHSA-X-' || cast(record_no AS string) AS source_record_id, 'npm' AS ecosystem, {NPM} AS package_name, 'pkg:npm/' || {NPM} AS purl, NULL::VARCHAR AS cpe23_uri, '< ' || cast(record_no % 9 AS string) AS version_range_raw, 'ghsa' AS range_type, true AS vulnerable FROM {{v_records}}",
    "n12_cve5_facts": f"""SELECT {CVE_ID} AS source_record_id, NULL::VARCHAR AS ecosystem, CASE WHEN record_no % 2 = 0 THEN 'v:' ELSE '' END || 'p' || cast(record_no AS string) AS package_name, NULL::VARCHAR AS purl, NULL::VARCHAR AS cpe23_uri,
  CASE record_no % 3 WHEN 0 THEN '>= ' || cast(record_no % 7 AS string) || ', < ' || cast(record_no % 7 + 2 AS string) WHEN 1 THEN '>= ' || cast(record_no % 7 AS string) || ', <= ' || cast(record_no % 7 + 1 AS string)
  ELSE '= ' || cast(record_no % 7 AS string) END AS version_range_raw, 'cve-list' AS range_type, true AS vulnerable FROM {{v_records}}""",
    "n05_kev_scores": f"SELECT 'cisa-kev' AS source_code, {CVE_ID} AS vulnerability_key, 'known-exploited' AS score_type, 1.0::DOUBLE AS score, '2030-01-02' AS observed_at FROM {{v_records}}",
    "n14_debian_facts": f"""SELECT {CVE_ID} AS source_record_id, 'debian:12' AS ecosystem, {NPM} AS package_name, 'pkg:deb/debian/' || {NPM} AS purl, NULL::VARCHAR AS cpe23_uri, '< 1.' || cast(record_no AS string) AS version_range_raw,
  'security-tracker:resolved' AS range_type, true AS vulnerable FROM {{v_records}} WHERE record_no % 4 <> 0
  UNION ALL SELECT {CVE_ID}, 'debian:11', {NPM}, 'pkg:deb/debian/' || {NPM}, NULL, '>= 0', 'security-tracker:open', true FROM {{v_records}}""",
    "n02_osv_records": f"""SELECT 'osv' AS source_code, {OWN} AS source_record_id, CASE WHEN regexp_full_match(vulnerability_key, 'CVE-[0-9]{{4}}-[0-9]{{4,}}') OR starts_with(vulnerability_key, 'GHSA-') THEN vulnerability_key ELSE {OWN} END AS vulnerability_key,
  CASE WHEN regexp_full_match(vulnerability_key, 'CVE-[0-9]{{4}}-[0-9]{{4,}}') OR starts_with(vulnerability_key, 'GHSA-') THEN 'identity-links-v6' ELSE 'osv-relations-v4' END AS normalizer_version, title, 'active' AS status FROM {{v_records}}""",
    "n08_osv_facts": f"""SELECT {OWN} AS source_record_id, CASE WHEN regexp_full_match(vulnerability_key, 'CVE-[0-9]{{4}}-[0-9]{{4,}}') OR starts_with(vulnerability_key, 'GHSA-') THEN vulnerability_key ELSE {OWN} END AS vulnerability_key, 'npm' AS ecosystem,
  'pkg-' || cast(record_no AS string) AS package_name, 'pkg:npm/pkg-' || cast(record_no AS string) AS purl,
  '>= ' || cast(record_no % 7 AS string) || CASE WHEN record_no % 2 = 0 THEN ', < ' ELSE ', <= ' END || cast(record_no % 9 + 1 AS string) AS version_range_raw, 'SEMVER' AS range_type, true AS vulnerable FROM {{v_records}}""",
    "n16_osv_severity": f"SELECT {OWN} AS source_record_id, 'cvss' AS scoring_system, '3.1' AS scoring_version, 9.8::DOUBLE AS score, 'CRITICAL' AS severity_label FROM {{v_records}}",
    "n17_osv_references": f"SELECT {OWN} AS source_record_id, source_url AS url, lower(trim(source_url)) AS normalized_url FROM {{v_records}} WHERE trim(source_url) <> ''",
    "d06_record_identifiers": f"SELECT {OWN} AS source_record_id, {OWN} AS identifier FROM {{v_records}} UNION ALL SELECT {OWN}, vulnerability_key FROM {{v_records}}",
    "x03_after_cursor": "SELECT record_no, modified_at AS stamp, source_record_id AS id FROM {v_records} WHERE modified_at > '2022' OR (modified_at = '2022' AND source_record_id <> 'NVD-1')",
    "d13_grouped_descriptions": r"""SELECT vulnerability_key, description, sources, row_number() OVER (PARTITION BY vulnerability_key ORDER BY length(folded) DESC, folded) AS rn FROM (
  SELECT vulnerability_key, folded, min(description) AS description, string_agg(DISTINCT source_code, ',' ORDER BY source_code) AS sources
  FROM (SELECT *, lower(trim(regexp_replace(description, '\s+', ' ', 'g'))) AS folded FROM {v_records}) WHERE folded <> '' GROUP BY 1, 2)""",
    "d15_headlines": r"""SELECT vulnerability_key, headline FROM (SELECT vulnerability_key, t AS headline, row_number() OVER (PARTITION BY vulnerability_key ORDER BY CASE WHEN length(t) < 12 OR regexp_matches(lower(t), '^(untitled|unknown|n/a|cve-\d+-\d+)$') THEN 25 ELSE 0 END
  - CASE WHEN source_code IN ('ghsa', 'osv', 'npm-advisory') THEN 30 WHEN source_code IN ('nvd-cve', 'cve-list-v5') THEN 20 ELSE 10 END, length(t), t) AS rn FROM (SELECT *, trim(title) AS t FROM {v_records}) WHERE t <> '') WHERE rn = 1""",
    "f52_triaged_references": """SELECT vulnerability_key, url, row_number() OVER (PARTITION BY vulnerability_key ORDER BY url) AS rn FROM (SELECT DISTINCT vulnerability_key, url FROM (
  SELECT *, max(fix) OVER (PARTITION BY vulnerability_key) AS any_fix FROM (SELECT *, regexp_matches(lower(concat_ws(' ', url, ref_type)), 'advisory|patch|vendor|errata') AS fix FROM {v_references})) WHERE fix OR NOT any_fix) QUALIFY rn <= 12""",
    "d16_ranked_aliases": """SELECT vulnerability_key, identifier, row_number() OVER (PARTITION BY vulnerability_key ORDER BY CASE WHEN starts_with(identifier, 'CVE-') THEN 0 WHEN starts_with(identifier, 'GHSA-') THEN 1
  WHEN starts_with(identifier, 'OSV-') THEN 2 ELSE 3 END, identifier) AS rn FROM (SELECT DISTINCT vulnerability_key, identifier FROM {v_identifiers})""",
    "f53_relation_groups": """SELECT DISTINCT * FROM (SELECT vulnerability_key, upper(substr(relation_type, 1, 1)) || substr(relation_type, 2) AS label, upper(related_identifier) AS identifier FROM {v_relations}
  UNION ALL SELECT upper(related_identifier), 'Downstream', vulnerability_key FROM {v_relations} WHERE relation_type = 'upstream') WHERE vulnerability_key <> identifier""",
}
SQL = {name: oracle(sql) for name, sql in _SQL.items()}
