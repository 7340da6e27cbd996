"""Source records from spool lines, per source family: N1-N21, N24, N29, N30, M17, D6, P26, P27.

A line is parsed once into a variant; every family reads its own paths from it.
All families are branches of one projection; each evidence table explodes its own
group from the record rows. Steps are columns of their own, so that no plan
repeats an expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.functions.identity import ADVISORY_ID, EMBEDDED_CVE, EXACT_CVE, OWNING_PREFIXES, is_cve, is_vulnerability_id, normalize, preferred_identifier, raw_guid, vulnerability_guid
from vulnlake.functions.packages import cpe_product, debian_ecosystem, escape_data, present, purl_without_version, to_purl
from vulnlake.functions.severity import cvss_version, cvss_version_from_type, severity_from_score, with_cvss_score

# --- fixed values ---------------------------------------------------------
INIT_SOURCES = ["nvd-cve-init", "osv-init", "ghsa-init", "android-osv-init", "google-osv-init", "maven-osv-init"]
FAMILIES = {
    "nvd": ["nvd-cve", "nvd-cve-init"],
    "osv": [
        "osv", "osv-init", "ghsa-init", "android-osv", "android-osv-init", "google-osv", "google-osv-init", "maven-osv", "maven-osv-init",
        "go-advisory", "cargo-advisory", "ubuntu-osv", "pypi-advisory",
    ],
    "ghsa": ["ghsa", "npm-advisory", "npm-audit"],
    "cve5": ["cve-list-v5"],
    "kev": ["cisa-kev"],
    "epss": ["first-epss"],
}
SOURCE_ECOSYSTEMS = {"nuget-advisory": "nuget", "maven-advisory": "maven", "npm-advisory": "npm", "npm-audit": "npm", "pypi-advisory": "pypi"}
EVIDENCE_ONLY = ["MINI-", "CGA-", "ECHO-"]
EXPLOIT_SOURCES = ["exploitdb", "metasploit", "nuclei-templates", "poc-in-github", "trickest-cve", "seebug"]
TITLE_LENGTH = 220
CATALOG_VERSION, OSV_VERSION, PROMOTED = "catalog-v1", "osv-relations-v4", "identity-links-v6"
PROJECTION, UNLINKED = "evidence-projection-v1", "evidence-projection-unlinked-v1"
# --------------------------------------------------------------------------

#: Columns that tie an evidence row to its record.
_IDENTITY = ["source_code", "raw_index_id", "vulnerability_key", "source_record_id"]


def text(node: Column, path: str) -> Column:
    """Text at a path; other JSON values as their text, null if absent."""
    return F.try_variant_get(node, path, "string")


def items(node: Column, path: str) -> Column:
    """The items of an array, none if it is no array."""
    return F.coalesce(F.try_variant_get(node, path, "array<variant>"), F.array().cast("array<variant>"))


def texts(node: Column, path: str) -> Column:
    """Non-blank texts of an array."""
    return F.filter(F.transform(items(node, path), lambda v: F.try_variant_get(v, "$", "string")), lambda t: F.trim(t) != "")


def number(node: Column, path: str) -> Column:
    """A number that is written as one, not as text."""
    kind = F.schema_of_variant(F.try_variant_get(node, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(node, path, "double"))


def first_text(node: Column, *paths: str) -> Column:
    """The first non-blank text of several paths."""
    return F.coalesce(*(present(text(node, p)) for p in paths))


def localised(node: Column, path: str, language: str = "en") -> Column:
    """The first non-blank value in a language."""
    fits = lambda v: (F.lower(text(v, "$.lang")) == language) & (F.trim(text(v, "$.value")) != "")
    return text(F.try_element_at(F.filter(items(node, path), fits), F.lit(1)), "$.value")


def unique(values: Column) -> Column:
    return F.array_distinct(values)


def is_text(node: Column) -> Column:
    return F.schema_of_variant(node).startswith("STRING")


def present_items(node: Column, path: str) -> Column:
    return F.explode(items(node, path))


# Facts ---------------------------------------------------------------------


def _facts(df: DataFrame, kind: str, how: Column | str, **columns: Column) -> DataFrame:
    """Fact rows of one family: identity, and the fact's columns (null where not given)."""
    none = F.lit(None).cast("string")
    value = lambda c: columns.get(c, none).cast("string").alias(c)
    return df.select(
        *_IDENTITY, F.lit(kind).alias("fact_type"), value("ecosystem"), value("package_name"), value("purl"), value("cpe23_uri"), value("version_range_raw"),
        (F.lit(how) if isinstance(how, str) else how).cast("string").alias("range_type"), columns.get("vulnerable", F.lit(True)).alias("vulnerable"),
    )


def _fold_events(events: Column) -> Column:
    """Bounds of one OSV range, by a fold over its events; a lower bound that
    stays open closes the list."""
    state = F.struct(F.lit(None).cast("string").alias("low"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, event: Column) -> Column:
        sign = F.when(event["last"].isNull(), "< ").otherwise("<= ")
        closed = F.concat(F.coalesce(F.concat(F.lit(">= "), acc["low"], F.lit(", ")), F.lit("")), sign, event["high"])
        return F.struct(
            F.when(event["low"].isNotNull(), event["low"]).when(event["high"].isNotNull(), F.lit(None).cast("string")).otherwise(acc["low"]).alias("low"),
            F.when(event["low"].isNull() & event["high"].isNotNull(), F.array_append(acc["out"], closed)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(events, state, step, lambda acc: F.concat(acc["out"], F.filter(F.array(F.concat(F.lit(">= "), acc["low"])), lambda e: e.isNotNull())))


def osv_range_expressions(df: DataFrame, range_column: str, name: str) -> DataFrame:
    """Adds the range expressions of an OSV range; its JSON if it has none."""
    event = lambda e: F.struct(
        present(text(e, "$.introduced")).alias("low"), text(e, "$.last_affected").alias("last"),
        present(F.coalesce(text(e, "$.fixed"), text(e, "$.limit"), text(e, "$.last_affected"))).alias("high"),
    )
    folded = df.withColumn("__events", F.transform(items(F.col(range_column), "$.events"), event)).withColumn("__out", _fold_events(F.col("__events")))
    return folded.withColumn(name, F.when(F.size("__out") > 0, F.col("__out")).otherwise(F.array(F.to_json(range_column)))).drop("__events", "__out")


def osv_facts(normalized: DataFrame) -> DataFrame:
    """Ranges of each package, else its versions, else the package alone."""
    rows = normalized.where("family = 'osv'").select(*_IDENTITY, F.posexplode(items(F.col("payload"), "$.affected")).alias("at", "item"))
    item = F.col("item")
    rows = rows.withColumns({"ecosystem": text(item, "$.package.ecosystem"), "name": text(item, "$.package.name"), "given": text(item, "$.package.purl"), "versions": texts(item, "$.versions")})
    rows = rows.withColumn("purl", F.coalesce("given", to_purl(F.col("ecosystem"), F.col("name")))).withColumn("ranges", items(item, "$.ranges"))
    common = {"ecosystem": F.col("ecosystem"), "package_name": F.col("name"), "purl": F.col("purl")}
    each = osv_range_expressions(rows.where(F.size("ranges") > 0).withColumn("range", F.explode("ranges")), "range", "expressions")
    each = each.withColumn("expression", F.explode("expressions"))
    ranged = _facts(each, "package", text(F.col("range"), "$.type"), version_range_raw=F.col("expression"), **common)
    bare = rows.where(F.size("ranges") == 0)
    listed = _facts(bare.withColumn("version", F.explode("versions")), "package", "versions", version_range_raw=F.concat(F.lit("= "), F.col("version")), **common)
    alone = _facts(bare.where((F.size("versions") == 0) & (F.trim("name") != "")), "package", F.lit(None), **common)
    return ranged.unionByName(listed).unionByName(alone)


_CPE_MATCH = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("criteria", "from_in", "from_ex", "to_in", "to_ex")] + [T.StructField("vulnerable", T.BooleanType())])
)


def walk_cpe_matches(node: object) -> list[dict]:
    """CPE matches of a configuration tree in reading order, at any depth."""
    out, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, list):
            stack.extend(reversed(at))
        elif isinstance(at, dict):
            if at.get("criteria") is not None:
                out.append(at)
            matches = at.get("cpeMatch")
            nodes = at.get("nodes")
            stack.extend({"__match": m} for m in reversed(matches if isinstance(matches, list) else []))
            stack.extend(reversed(nodes if isinstance(nodes, list) else []))
            if "__match" in at and isinstance(at["__match"], dict):
                out.append(at["__match"])
    return out


@F.pandas_udf(_CPE_MATCH)
def cpe_matches_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    fields = {"criteria": "criteria", "from_in": "versionStartIncluding", "from_ex": "versionStartExcluding", "to_in": "versionEndIncluding", "to_ex": "versionEndExcluding"}

    def of(configurations: str | None) -> list[dict] | None:
        if configurations is None:
            return None
        found = walk_cpe_matches(json.loads(configurations))
        return [{k: m.get(v) for k, v in fields.items()} | {"vulnerable": m.get("vulnerable", True)} for m in found]

    for batch in batches:
        yield pd.Series([of(c) for c in batch], dtype=object)


def nvd_facts(normalized: DataFrame) -> DataFrame:
    """CPE matches with their bounds in fixed order."""
    configurations = F.to_json(F.try_variant_get("cve", "$.configurations", "variant"))
    rows = normalized.where("family = 'nvd'").withColumn("matches", cpe_matches_udf(configurations))
    rows = rows.select(*_IDENTITY, F.inline("matches")).where(F.trim("criteria") != "")
    part = lambda sign, field: F.when(F.trim(field) != "", F.concat(F.lit(sign), F.col(field)))
    bounds = F.filter(F.array(part(">= ", "from_in"), part("> ", "from_ex"), part("<= ", "to_in"), part("< ", "to_ex")), lambda p: p.isNotNull())
    rows = rows.withColumn("bounds", F.nullif(F.array_join(bounds, ", "), F.lit("")))
    how = F.when(F.col("bounds").isNull(), "cpe_match_no_range").otherwise("cpe_match")
    return _facts(
        rows, "cpe", how, ecosystem=F.lit("cpe"), package_name=cpe_product(F.col("criteria")), cpe23_uri=F.col("criteria"), version_range_raw=F.col("bounds"),
        vulnerable=F.coalesce(F.col("vulnerable"), F.lit(True)),
    )


def cve5_facts(normalized: DataFrame) -> DataFrame:
    """Affected versions of a CVE record."""
    rows = normalized.where("family = 'cve5'").select(*_IDENTITY, present_items(F.col("payload"), "$.containers.cna.affected").alias("item"))
    names = F.filter(F.array(text(F.col("item"), "$.vendor"), text(F.col("item"), "$.product")), lambda t: F.trim(t) != "")
    rows = rows.withColumn("name", F.array_join(names, ":")).where("name <> ''").withColumn("version", present_items(F.col("item"), "$.versions"))
    v = F.col("version")
    rows = rows.where(F.lower(text(v, "$.status")) == "affected")
    rows = rows.withColumns({"one": text(v, "$.version"), "below": text(v, "$.lessThan"), "upto": text(v, "$.lessThanOrEqual")})
    bounds = F.coalesce(
        F.concat(F.lit(">= "), "one", F.lit(", < "), "below"), F.concat(F.lit(">= "), "one", F.lit(", <= "), "upto"), F.concat(F.lit("< "), "below"),
        F.concat(F.lit("<= "), "upto"), F.concat(F.lit("= "), "one"), F.to_json("version"),
    )
    return _facts(rows, "package", "cve-list", package_name=F.col("name"), version_range_raw=bounds)


def ghsa_facts(normalized: DataFrame) -> DataFrame:
    """Vulnerable ranges of packages."""
    rows = normalized.where("family = 'ghsa'").select(*_IDENTITY, present_items(F.col("payload"), "$.vulnerabilities").alias("item"))
    item = F.col("item")
    rows = rows.withColumns({"ecosystem": first_text(item, "$.package.ecosystem", "$.package.type"), "name": text(item, "$.package.name")}).where(F.trim("name") != "")
    return _facts(
        rows, "package", "ghsa", ecosystem=F.col("ecosystem"), package_name=F.col("name"), purl=to_purl(F.col("ecosystem"), F.col("name")),
        version_range_raw=text(item, "$.vulnerable_version_range"),
    )


def debian_facts(rows: DataFrame) -> DataFrame:
    """Open and resolved releases of Debian packages; other states give none."""
    packages = rows.select(*_IDENTITY, F.explode("packages").alias("name", "advisory")).where(F.trim("name") != "")
    releases = packages.select(*_IDENTITY, "name", F.explode(F.try_variant_get("advisory", "$.releases", "map<string,variant>")).alias("release", "state"))
    releases = releases.withColumns({"status": F.lower(text(F.col("state"), "$.status")), "fixed": text(F.col("state"), "$.fixed_version")})
    bounds = F.when(F.col("status") == "open", ">= 0").when((F.col("status") == "resolved") & (F.trim("fixed") != "") & (F.col("fixed") != "0"), F.concat(F.lit("< "), "fixed"))
    releases = releases.withColumn("bounds", bounds).where("bounds is not null")
    return _facts(
        releases, "package", F.concat(F.lit("security-tracker:"), "status"), ecosystem=debian_ecosystem(F.col("release")), package_name=F.col("name"),
        purl=F.concat(F.lit("pkg:deb/debian/"), escape_data(F.col("name"))), version_range_raw=F.col("bounds"),
    )


def generic_facts(normalized: DataFrame) -> DataFrame:
    """Facts of named products; Debian packages instead where there are any."""
    p = F.col("payload")
    by_source = F.lit(None).cast("string")
    for name, eco in SOURCE_ECOSYSTEMS.items():
        by_source = F.when(F.lower("source_in") == name, eco).otherwise(by_source)
    rows = normalized.where("family in ('other', 'kev')").withColumn("packages", F.try_variant_get("payload", "$.packages", "map<string,variant>"))
    named = rows.where("packages is null").withColumns(
        {
            "ecosystem": F.coalesce(first_text(p, "$.ecosystem", "$.packageEcosystem"), by_source), "name": first_text(p, "$.packageName", "$.package_name", "$.product"),
            "given": first_text(p, "$.purl"), "ranges": F.concat(texts(p, "$.vulnerableRanges"), F.filter(F.array(present(text(p, "$.advisory.versions"))), lambda r: r.isNotNull())),
        }
    )
    named = named.withColumn("purl", F.coalesce("given", to_purl(F.col("ecosystem"), F.col("name"))))
    with_name = named.where("name is not null")
    common = {"ecosystem": F.col("ecosystem"), "package_name": F.col("name"), "purl": F.col("purl")}
    alone = _facts(with_name.where(F.size("ranges") == 0), "package", "source", **common)
    first = with_name.withColumn("folded", F.transform("ranges", F.lower)).select("*", F.posexplode("ranges").alias("at", "bounds"))
    first = first.where(F.array_position("folded", F.lower("bounds")) == F.col("at") + 1)
    ranged = _facts(first, "package", "vendor", version_range_raw=F.col("bounds"), **common)
    products = _facts(named.withColumn("product", F.explode(texts(p, "$.affectedProducts"))), "product", "source", ecosystem=F.col("ecosystem"), package_name=F.col("product"))
    vendor, product = present(text(p, "$.vendorProject")), present(text(p, "$.product"))
    shown = named.withColumn("shown", F.coalesce(F.concat(vendor, F.lit(":"), product), product)).where("shown is not null")
    vendors = _facts(shown, "product", "source", package_name=F.col("shown"))
    out = debian_facts(rows.where("packages is not null"))
    for part in (alone, ranged, products, vendors):
        out = out.unionByName(part)
    return out


def affected_facts(normalized: DataFrame) -> DataFrame:
    """One row per distinct fact of a record, of all families."""
    out = nvd_facts(normalized)
    for part in (osv_facts, ghsa_facts, cve5_facts, generic_facts):
        out = out.unionByName(part(normalized))
    return out.distinct().withColumns({"normalized_package_name": F.lower("package_name"), "purl_without_version": purl_without_version(F.col("purl"))})


# Severity ------------------------------------------------------------------


def _scores(df: DataFrame, system: Column, version: Column, vector: Column, value: Column, label: Column) -> DataFrame:
    return df.select(
        *_IDENTITY, system.cast("string").alias("scoring_system"), version.cast("string").alias("scoring_version"), F.lit("base").alias("score_type"),
        vector.cast("string").alias("vector_string"), value.cast("double").alias("score"), label.cast("string").alias("severity_label"),
    )


def severity_scores(normalized: DataFrame) -> DataFrame:
    """One row per score, of all families."""
    none = F.lit(None).cast("string")
    metrics = normalized.where("family = 'nvd'").select(*_IDENTITY, F.explode(F.try_variant_get("cve", "$.metrics", "map<string,array<variant>>")).alias("metric", "group"))
    item = F.col("item")
    nvd = metrics.withColumn("item", F.explode("group"))
    label = F.coalesce(text(item, "$.cvssData.baseSeverity"), text(item, "$.baseSeverity"))
    nvd = _scores(nvd, F.lit("cvss"), text(item, "$.cvssData.version"), text(item, "$.cvssData.vectorString"), number(item, "$.cvssData.baseScore"), label)
    nvd = nvd.where("coalesce(scoring_version, vector_string, cast(score as string), severity_label) is not null")

    osv = normalized.where("family = 'osv'").select(*_IDENTITY, present_items(F.col("payload"), "$.severity").alias("item"))
    osv = osv.withColumns({"kind": F.coalesce(text(item, "$.type"), F.lit("vendor")), "given": text(item, "$.score"), "value": number(item, "$.score")})
    osv = with_cvss_score(osv.withColumn("by_type", cvss_version_from_type(F.col("kind"))), "given", "by_type", "computed")
    osv = osv.withColumn("vector", F.when(F.upper("given").startswith("CVSS:") | F.col("computed").isNotNull(), F.col("given")))
    osv = osv.withColumns({"final": F.coalesce("value", "computed"), "version": F.coalesce(cvss_version(F.col("vector")), F.col("by_type"))})
    system = F.when(F.upper("kind").startswith("CVSS"), "cvss").otherwise(F.lower("kind"))
    osv = _scores(osv, system, F.col("version"), F.col("vector"), F.col("final"), severity_from_score(F.col("final"), F.col("version")))

    p = F.col("payload")
    generic = normalized.where("family in ('ghsa', 'other')").withColumns(
        {
            "vector": F.coalesce(text(p, "$.cvss.vector_string"), text(p, "$.cvss.vector")), "value": number(p, "$.cvss.score"),
            "own_label": first_text(p, "$.severityLabel", "$.severity", "$.hazardLevel"), "own": F.coalesce(number(p, "$.score"), number(p, "$.cvssScore")),
        }
    )
    upper = F.upper("vector")
    version = F.when(upper.startswith("CVSS:4."), "4.0").when(upper.startswith("CVSS:3.1"), "3.1").when(upper.startswith("CVSS:3.0"), "3.0")
    block = generic.where("vector is not null or value is not null").withColumn("version", version)
    block = _scores(block, F.lit("cvss"), F.col("version"), F.col("vector"), F.col("value"), severity_from_score(F.col("value"), F.col("version")))
    plain = generic.where("vector is null and value is null and (own_label is not null or own is not null)")
    plain = _scores(plain, F.lit("source"), none, none, F.col("own"), F.coalesce(F.col("own_label"), severity_from_score(F.col("own"), none)))
    return nvd.unionByName(osv).unionByName(block).unionByName(plain)


# References and weaknesses -------------------------------------------------


def evidence_references(normalized: DataFrame) -> DataFrame:
    """One row per distinct address of a record; blank ones dropped.

    References are texts or objects; generic sources add the links of single
    fields. The first of several rows with one address (without case) stays.
    """
    p, item = F.col("payload"), F.col("item")
    group = (
        F.when(F.col("family") == "nvd", items(F.col("cve"), "$.references")).when(F.col("family") == "cve5", items(p, "$.containers.cna.references"))
        .when(F.col("family") == "epss", F.array().cast("array<variant>")).otherwise(items(p, "$.references"))
    )
    listed = normalized.withColumn("group", group).select(*_IDENTITY, F.posexplode("group").alias("at", "item"))
    listed = listed.select(
        *_IDENTITY, "at", F.when(is_text(item), F.try_variant_get("item", "$", "string")).otherwise(F.coalesce(text(item, "$.url"), text(item, "$.href"))).alias("url"),
        F.coalesce(text(item, "$.type"), text(item, "$.refsource")).alias("ref_type"), texts(item, "$.tags").alias("tags"),
    )
    generic = normalized.where("family in ('other', 'kev')").withColumn("kind", F.when(F.col("family") == "kev", "kev").otherwise("advisory"))
    absolute = lambda c: F.when(c.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), c)
    single = F.array(*(absolute(text(p, f"$.{n}")) for n in ("sourceUrl", "artifactUrl", "notes", "knownRansomwareCampaignUse")), present(F.col("source_url")))
    extra = generic.select(*_IDENTITY, "kind", F.posexplode(single).alias("at", "url")).where("url is not null")
    extra = extra.select(*_IDENTITY, (F.col("at") + 1_000_000).alias("at"), "url", F.col("kind").alias("ref_type"), F.array("kind").alias("tags"))
    rows = listed.unionByName(extra).where(F.trim("url") != "")
    first = rows.groupBy(*_IDENTITY, F.lower("url").alias("folded")).agg(F.min(F.struct("at", "url", "ref_type", "tags")).alias("r"))
    return first.select(*_IDENTITY, "r.url", "r.ref_type", F.lower(F.trim("r.url")).alias("normalized_url"), F.to_json("r.tags").alias("tags_json"))


def record_weaknesses(normalized: DataFrame) -> DataFrame:
    """One row per distinct weakness with id or description."""
    p, item = F.col("payload"), F.col("item")
    nvd = normalized.where("family = 'nvd'").select(*_IDENTITY, present_items(F.col("cve"), "$.weaknesses").alias("w")).select(*_IDENTITY, present_items(F.col("w"), "$.description").alias("item"))
    nvd = nvd.select(*_IDENTITY, text(item, "$.value").alias("weakness_id"), F.lit(None).cast("string").alias("description")).where(F.trim("weakness_id") != "")
    group = F.when(F.try_variant_get("payload", "$.cwes", "variant").isNotNull() | (F.col("family") == "ghsa"), items(p, "$.cwes")).otherwise(items(p, "$.weaknesses"))
    rows = normalized.where("family in ('ghsa', 'other')").select(*_IDENTITY, F.explode(group).alias("item"))
    rows = rows.select(
        *_IDENTITY, F.when(is_text(item), present(F.try_variant_get("item", "$", "string"))).otherwise(F.coalesce(text(item, "$.cwe_id"), text(item, "$.id"))).alias("weakness_id"),
        F.when(~is_text(item), F.coalesce(text(item, "$.name"), text(item, "$.description"))).alias("description"),
    ).where("weakness_id is not null or description is not null")
    both = nvd.unionByName(rows).distinct()
    return both.select(*_IDENTITY, F.lit("CWE").alias("weakness_type"), "weakness_id", "description")


# Records -------------------------------------------------------------------


def generic_identifiers(envelope: Column, payload: Column, external_id: Column) -> Column:
    """Valid ids of the envelope and the payload, normalised and distinct."""
    own = F.transform(items(payload, "$.identifiers"), lambda v: F.when(F.schema_of_variant(v).startswith("STRING"), F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(text(v, "$.value"), text(v, "$.id"))))
    listed = F.concat(F.array(external_id), texts(envelope, "$.identifiers"), texts(payload, "$.aliases"), own)
    return unique(F.filter(F.transform(F.filter(listed, lambda v: F.trim(v) != ""), normalize), is_vulnerability_id))


def osv_upstream(payload: Column) -> Column:
    """Upstream ids of an OSV record; CVE ids in its metadata never count."""

    def of(path: str) -> Column:
        return F.transform(items(payload, path), lambda v: F.when(F.schema_of_variant(v).startswith("STRING"), F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(text(v, "$.id"), text(v, "$.value"))))

    listed = F.concat(of("$.upstream"), of("$.database_specific.upstream"), of("$.database_specific.upstream_ids"))
    return unique(F.filter(F.transform(F.filter(listed, lambda v: F.trim(v) != ""), normalize), is_vulnerability_id))


def canonical_source(source: Column) -> Column:
    """Initial loads belong to their source."""
    low = F.lower(source)
    return F.when(low.isin(*INIT_SOURCES), F.regexp_replace(low, "-init$", "")).otherwise(low)


def parse_envelopes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines as variants with ``is_valid``: an object with source, key and payload."""
    parsed = lines.where(F.trim(column) != "").withColumn("envelope", F.try_parse_json(column))
    v = F.col("envelope")
    valid = text(v, "$.sourceCode").isNotNull() & text(v, "$.externalKey").isNotNull() & F.try_variant_get(v, "$.payload", "variant").isNotNull()
    return parsed.withColumn("is_valid", F.coalesce(valid, F.lit(False)))


def normalize_envelopes(envelopes: DataFrame) -> DataFrame:
    """One source record per valid envelope, with nested evidence groups."""
    v, p = F.col("envelope"), F.col("payload")
    source = F.lower(F.col("source_in"))
    base = envelopes.where("is_valid").withColumns({"payload": F.try_variant_get(v, "$.payload", "variant"), "source_in": text(v, "$.sourceCode")})
    family = F.lit("other")
    for name, members in FAMILIES.items():
        family = F.when(source.isin(*members), name).otherwise(family)
    external = F.coalesce(text(v, "$.externalId"), text(v, "$.externalKey"))
    base = base.withColumns({"family": family, "source_code": canonical_source(F.col("source_in")), "external_id": external, "external_key": text(v, "$.externalKey")})
    kind, ext = F.col("family"), F.col("external_id")
    cve = F.when(kind == "nvd", F.coalesce(F.try_variant_get(p, "$.cve", "variant"), p))
    base = base.withColumn("cve", cve)
    n = F.col("cve")

    generic = generic_identifiers(v, p, ext)
    aliases = F.transform(texts(p, "$.aliases"), normalize)
    direct = unique(F.filter(aliases, is_cve))
    osv_id = F.coalesce(text(p, "$.id"), ext)
    osv_ids = unique(F.transform(F.filter(F.concat(F.array(osv_id), texts(p, "$.aliases")), is_vulnerability_id), normalize))
    cve5_id = text(p, "$.cveMetadata.cveId")
    strings = "array<string>"
    none = F.lit(None).cast("string")

    def by_family(default: Column, **cases: Column) -> Column:
        out = default
        for name, value in cases.items():
            out = F.when(kind == name, value).otherwise(out)
        return out

    nvd_text = localised(n, "$.descriptions")
    osv_title = text(p, "$.summary")
    cve5_title = text(p, "$.containers.cna.title")
    other_title = first_text(p, "$.title", "$.summary", "$.name", "$.vulnerabilityName")
    nvd_key = F.coalesce(text(n, "$.id"), ext)
    cve5_ids = unique(F.concat(generic, F.array(F.coalesce(cve5_id, ext))))
    step = base.withColumns(
        {
            "identifiers": by_family(generic, nvd=F.array(normalize(nvd_key)), osv=osv_ids, cve5=cve5_ids).cast(strings),
            "direct": F.when(kind == "osv", direct).otherwise(F.array().cast(strings)),
            "upstream": F.when(kind == "osv", osv_upstream(p)).otherwise(F.array().cast(strings)),
            "related_own": F.when(kind == "osv", unique(F.filter(F.transform(texts(p, "$.related"), normalize), is_vulnerability_id))).otherwise(F.array().cast(strings)),
            "own_key": by_family(
                ext, nvd=nvd_key, osv=osv_id, cve5=F.coalesce(cve5_id, preferred_identifier(cve5_ids, ext)),
                kev=F.coalesce(text(p, "$.cveID"), preferred_identifier(generic, ext)), epss=F.coalesce(text(p, "$.cve"), preferred_identifier(generic, ext)),
            ),
            "title": by_family(other_title, nvd=F.when(F.length(nvd_text) <= TITLE_LENGTH, nvd_text), osv=osv_title, ghsa=osv_title, cve5=cve5_title, kev=text(p, "$.vulnerabilityName"), epss=none),
            "description": by_family(
                F.coalesce(first_text(p, "$.description", "$.details", "$.shortDescription", "$.summary"), other_title), nvd=nvd_text,
                osv=F.coalesce(text(p, "$.details"), osv_title), ghsa=F.coalesce(text(p, "$.description"), osv_title),
                cve5=F.coalesce(localised(p, "$.containers.cna.descriptions"), cve5_title), kev=F.coalesce(text(p, "$.shortDescription"), text(p, "$.vulnerabilityName")), epss=none,
            ),
            "status": by_family(
                F.coalesce(first_text(p, "$.status", "$.state"), F.lit("active")), nvd=text(n, "$.vulnStatus"),
                osv=F.when(F.try_variant_get(p, "$.withdrawn", "string").isNull(), "active").otherwise("withdrawn"),
                ghsa=F.when(text(p, "$.withdrawn_at").isNull(), "active").otherwise("withdrawn"),
                cve5=F.coalesce(text(p, "$.cveMetadata.state"), F.lit("active")), kev=F.lit("known-exploited"), epss=F.lit("active"),
            ),
            "published_at": F.coalesce(
                text(v, "$.publishedAt"),
                by_family(first_text(p, "$.publishedAt", "$.published_at", "$.published", "$.dateAdded"), nvd=text(n, "$.published"), osv=text(p, "$.published"), ghsa=text(p, "$.published_at"), cve5=text(p, "$.cveMetadata.datePublished"), kev=text(p, "$.dateAdded"), epss=none),
            ),
            "modified_at": F.coalesce(
                text(v, "$.modifiedAt"),
                by_family(first_text(p, "$.modifiedAt", "$.updated_at", "$.modified", "$.updatedAt"), nvd=text(n, "$.lastModified"), osv=text(p, "$.modified"), ghsa=text(p, "$.updated_at"), cve5=text(p, "$.cveMetadata.dateUpdated"), kev=none, epss=none),
            ),
            "source_url": text(v, "$.sourceUrl"),
            "record_hash": F.coalesce(text(v, "$.recordHash"), F.lit("")),
            "force_normalize": F.coalesce(F.try_variant_get(v, "$.forceNormalize", "boolean"), F.lit(False)),
            "snapshot_id": text(v, "$.snapshotId"),
            "raw_index_id": raw_guid(F.col("source_code"), F.col("external_key")),
            "n_severity": F.when(kind == "osv", F.size(items(p, "$.severity"))).otherwise(0),
            "n_references": F.when(kind == "osv", F.size(items(p, "$.references"))).otherwise(0),
        }
    )
    return _settle_identity(step)


_CVE, _EMBEDDED, _ADVISORY = re.compile(EXACT_CVE), re.compile(EMBEDDED_CVE), re.compile(ADVISORY_ID)


def _valid(value: str) -> bool:
    return 4 <= len(value) <= 160 and bool((_CVE if value.startswith("CVE-") else _ADVISORY).match(value))


def canonical_key(own: str, identifiers: list[str]) -> str:
    """F4 for one record: its canonical key from its own id and direct aliases."""
    if _CVE.match(own):
        return own
    if found := _EMBEDDED.match(own):
        return found[1]
    known = dict.fromkeys([*(i for i in identifiers if _valid(i)), own])
    named = {i if _CVE.match(i) else m[1] for i in known if (m := _EMBEDDED.match(i)) or _CVE.match(i)}
    if named:
        return named.pop() if len(named) == 1 else own
    for prefix in OWNING_PREFIXES:
        if own.startswith(prefix) and _valid(own):
            return own
        owners = [i for i in known if i.startswith(prefix)]
        if len(owners) == 1:
            return owners[0]
    return own


def settle(family: str, own: str, external: str, identifiers: list[str], direct: list[str], upstream: list[str], related: list[str], bare: bool) -> dict:
    """N2, N7 for one record: key, version and relations.

    ``bare`` marks a distribution's projection without content of its own (P26): it
    goes to the one CVE it names, first as alias, then as relation, and is left
    unlinked if there is none or more.
    """
    related = [i for i in related if i not in set(upstream)]
    if len(direct) > 1:
        related = list(dict.fromkeys([*related, *direct]))
    key, version = own, OSV_VERSION if family == "osv" else CATALOG_VERSION
    if bare:
        linked = list(dict.fromkeys(i for i in [*upstream, *related] if _CVE.match(i)))
        choice = direct if direct else linked
        key, version = (choice[0], PROJECTION) if len(choice) == 1 else (own, UNLINKED)
    if version != UNLINKED:
        promoted = canonical_key(key, identifiers)
        key, version = promoted, PROMOTED if promoted != key else version
    other = lambda ids: [i for i in ids if i not in (key, external)]
    upstream = other(upstream)
    related = [i for i in other(related) if i not in set(upstream)]
    return {"key": key, "version": version, "upstream": upstream, "related": related, "identifiers": list(dict.fromkeys(i for i in [*identifiers, key] if i.strip()))}


_SETTLED = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("version", T.StringType())] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("upstream", "related", "identifiers")]
)


@F.pandas_udf(_SETTLED)
def settle_udf(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [settle(f, o, e, list(i), list(d), list(u), list(r), bool(b)) for f, o, e, i, d, u, r, b in zip(*batch)]
        yield pd.DataFrame(rows, columns=["key", "version", "upstream", "related", "identifiers"])


def _settle_identity(step: DataFrame) -> DataFrame:
    """Relations, evidence-only projections and the canonical key."""
    own = normalize(F.col("own_key"))
    starts = F.lit(False)
    for prefix in EVIDENCE_ONLY:
        starts = starts | own.startswith(prefix)
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    bare = (F.col("family") == "osv") & starts & blank("title") & blank("description") & (F.col("n_severity") == 0) & (own.startswith("ECHO-") | (F.col("n_references") == 0))
    settled = settle_udf("family", own, normalize(F.col("external_id")), "identifiers", "direct", "upstream", "related_own", F.coalesce(bare, F.lit(False)))
    step = step.withColumn("settled", settled)
    return step.withColumns(
        {
            "vulnerability_key": F.col("settled.key"), "normalizer_version": F.col("settled.version"), "upstream": F.col("settled.upstream"),
            "related": F.col("settled.related"), "identifiers": F.col("settled.identifiers"), "vulnerability_id": vulnerability_guid(F.col("settled.key")),
            "source_record_id": F.col("external_id"),
        }
    ).drop("settled", "related_own", "own_key", "direct")


def source_records(normalized: DataFrame) -> DataFrame:
    """The catalog part of normalised records."""
    return normalized.select(
        "source_code", "source_record_id", "vulnerability_id", "vulnerability_key", "title", "description", "status", "published_at", "modified_at",
        "source_url", "record_hash", "normalizer_version", "force_normalize",
    )


def record_identifiers(normalized: DataFrame) -> DataFrame:
    """One row per identifier of a record."""
    return normalized.select("source_code", "source_record_id", "vulnerability_id", "vulnerability_key", F.explode("identifiers").alias("identifier"))


def record_relations(normalized: DataFrame) -> DataFrame:
    """One row per upstream or related identifier of a record."""
    tagged = lambda c, kind: F.transform(F.col(c), lambda i: F.struct(F.lit(kind).alias("relation_type"), i.alias("related_identifier")))
    both = F.concat(tagged("upstream", "upstream"), tagged("related", "related"))
    return normalized.select("source_code", "source_record_id", "vulnerability_id", "vulnerability_key", F.inline(both))


def record_exploits(normalized: DataFrame) -> DataFrame:
    """Exploit rows of exploit sources."""
    p = F.col("payload")
    has = text(p, "$.sourceKey").isNotNull() & (text(p, "$.artifactType").isNotNull() | F.col("source_in").isin(*EXPLOIT_SOURCES))
    return normalized.where(has).select(
        "source_code", "raw_index_id", F.coalesce(text(p, "$.sourceKey"), F.col("external_id")).alias("source_key"), F.to_json("identifiers").alias("identifiers"), "title",
        F.coalesce(text(p, "$.sourceUrl"), F.col("source_url")).alias("source_url"), text(p, "$.artifactType").alias("artifact_type"), text(p, "$.exploitType").alias("exploit_type"),
        text(p, "$.maturity").alias("maturity"), text(p, "$.verificationStatus").alias("verification_status"), "published_at", "modified_at", "snapshot_id",
    )


def threat_scores(normalized: DataFrame) -> DataFrame:
    """Exploitation scores of the two threat feeds."""
    p, epss = F.col("payload"), F.col("family") == "epss"
    return normalized.where(F.col("family").isin("epss", "kev")).select(
        "source_code", "raw_index_id", "vulnerability_key", F.when(epss, "epss").otherwise("known-exploited").alias("score_type"),
        F.when(epss, F.try_variant_get(p, "$.epss", "double")).otherwise(1.0).alias("score"), F.when(epss, F.try_variant_get(p, "$.percentile", "double")).alias("percentile"),
        F.when(epss, text(p, "$.observedAt")).otherwise(text(p, "$.dateAdded")).alias("observed_at"),
    )
