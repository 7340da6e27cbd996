"""Records of exploit and advisory feeds: N32, N33, N37. Files come as rows of ``path`` and ``body``.

Exploit adapters give ``source_key, identifiers, title, source_url, artifact_type,
exploit_type, maturity, verification_status, language, platform, author,
published_at, modified_at``; a file that names no CVE, or that cannot be read,
gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.packages import present
from vulnlake.functions.text import DOMESTIC_PATTERNS, artifact_type, exploit_class, extract_cves, extract_identifiers, language_of_path, maturity, platform_of_path

#: Characters of a body that tell the class of an exploit.
CLASS_CHARS = 4000


def _entry(df: DataFrame, provider: str, verified: Column | bool, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    sure = F.lit(verified) if isinstance(verified, bool) else verified
    fixed = {"artifact_type": artifact_type(F.lit(provider), F.col("path"), F.array().cast("array<string>")), "maturity": maturity(F.lit(provider), sure), "verification_status": F.lit("unreviewed")}
    values = fixed | columns
    order = ["source_key", "identifiers", "title", "source_url", "artifact_type", "exploit_type", "maturity", "verification_status", "language", "platform", "author", "published_at", "modified_at"]
    return df.where(F.size(columns["identifiers"]) > 0).select(*(values.get(name, none).alias(name) for name in order))


def _ruby_value(body: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(body, rf"(?i)['\"]{key}['\"]\s*=>\s*['\"]([^'\"]+)['\"]", 1), F.lit(""))


def framework_modules(files: DataFrame, base_url: str) -> DataFrame:
    """Modules of an exploit framework (Ruby): name and authors from the header,
    platform from the path. Only exploits and auxiliaries count."""
    body, path = F.col("body"), F.col("path")
    modules = files.where(path.endswith(".rb") & path.rlike("(^|/)modules/(exploits|auxiliary)/"))
    title = F.coalesce(_ruby_value(body, "Name"), path)
    block = F.regexp_extract(body, r"(?is)['\"]Author['\"]\s*=>\s*(\[.*?\]|['\"][^'\"]+['\"])", 1)
    author = F.nullif(F.array_join(F.regexp_extract_all(block, F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1)), ", "), F.lit(""))
    return _entry(
        modules, "metasploit", True, source_key=path, identifiers=extract_cves(body), title=title, source_url=F.concat(F.lit(base_url), path), exploit_type=exploit_class(F.concat_ws(" ", path, title, F.substring(body, 1, CLASS_CHARS))),
        verification_status=F.lit("framework_module"), language=language_of_path(path), platform=platform_of_path(path), author=author,
    )


def template_entries(documents: DataFrame, base_url: str) -> DataFrame:
    """Detection templates (YAML as JSON in ``body``) with the CVE ids of their
    classification, tags and id."""
    v = F.try_parse_json("body")
    text = lambda p: F.try_variant_get(v, p, "string")
    ids = extract_cves(F.concat_ws(" ", text("$.id"), text("$.info.classification"), text("$.info.tags"), text("$.info.name")))
    verified = F.coalesce(F.try_variant_get(v, "$.info.metadata.verified", "boolean"), F.lit(False))
    authors = F.coalesce(F.array_join(F.try_variant_get(v, "$.info.author", "array<string>"), ", "), text("$.info.author"))
    return _entry(
        documents, "nuclei-templates", verified, source_key=F.coalesce(present(text("$.id")), F.col("path")), identifiers=ids, title=F.coalesce(text("$.info.name"), text("$.id"), F.col("path")),
        source_url=F.concat(F.lit(base_url), "path"), exploit_type=exploit_class(F.concat_ws(" ", text("$.info.name"), text("$.info.description"), text("$.info.tags"))),
        verification_status=F.when(verified, "source_verified").otherwise("template_reviewed"), language=F.lit("yaml"), platform=text("$.info.metadata.product"), author=authors,
    )


def repository_entries(files: DataFrame) -> DataFrame:
    """Proof repositories listed per CVE, one JSON file each, named by the CVE."""
    cve = F.upper(F.regexp_extract("path", r"(?i)(?:^|/)(CVE-\d{4}-\d+)\.json$", 1))
    kind = "array<struct<full_name:string,name:string,description:string,html_url:string,created_at:string,pushed_at:string,updated_at:string,owner:struct<login:string>>>"
    rows = files.withColumn("cve", F.nullif(cve, F.lit(""))).where("cve is not null").select("path", "cve", F.explode(F.from_json("body", kind)).alias("r")).where("r.full_name is not null")
    return _entry(
        rows, "poc-in-github", False, source_key=F.concat_ws(":", "cve", "r.full_name"), identifiers=F.array("cve"), title=F.coalesce(present(F.col("r.description")), F.col("r.full_name")), source_url=F.col("r.html_url"),
        artifact_type=F.lit("github_repository"), exploit_type=exploit_class(F.concat_ws(" ", "r.name", "r.description")), author=F.col("r.owner.login"), published_at=F.col("r.created_at"), modified_at=F.coalesce("r.pushed_at", "r.updated_at"),
    )


def index_pages(files: DataFrame) -> DataFrame:
    """Markdown pages of a CVE index, named by the CVE, titled by their first heading."""
    cve = F.nullif(F.upper(F.regexp_extract("path", r"(?i)(?:^|/)(CVE-\d{4}-\d+)\.md$", 1)), F.lit(""))
    rows = files.withColumn("cve", cve).where("cve is not null")
    title = F.coalesce(present(F.regexp_extract("body", r"(?m)^###\s+\[?([^\]\n]+)\]?", 1)), F.col("cve"))
    return _entry(rows, "trickest-cve", False, source_key=F.col("cve"), identifiers=F.array("cve"), title=F.trim(title), artifact_type=F.lit("poc_index"), exploit_type=exploit_class(F.concat_ws(" ", title, F.substring("body", 1, CLASS_CHARS))), language=F.lit("markdown"), author=F.lit("trickest"))


def csaf_envelopes(documents: DataFrame) -> DataFrame:
    """CSAF documents as envelopes ``external_id, published_at, modified_at,
    identifiers, payload_json``; ids are those of the vulnerabilities and the title,
    after the advisory's own. A document without tracking id is named by its file."""
    v = F.try_parse_json("body")
    text = lambda p: F.try_variant_get(v, p, "string")
    own = F.coalesce(present(text("$.document.tracking.id")), F.regexp_extract("path", r"([^/]+?)(?:\.json)?$", 1))
    named = extract_identifiers(F.concat_ws(" ", text("$.vulnerabilities"), text("$.document.title")), DOMESTIC_PATTERNS)
    return documents.where(v.isNotNull()).select(
        own.alias("external_id"), text("$.document.tracking.initial_release_date").alias("published_at"), text("$.document.tracking.current_release_date").alias("modified_at"),
        F.array_distinct(F.concat(F.array(own), named)).alias("identifiers"), F.col("body").alias("payload_json"),
    )


def audit_records(pages: DataFrame) -> DataFrame:
    """Pages of a bulk audit, a map from package to its advisories, as records of
    the advisory family: ``external_key, external_id, identifiers, payload_json``."""
    kind = "struct<id:string,url:string,title:string,cves:array<string>,severity:string,vulnerable_versions:string,patched_versions:string,cwe:array<string>>"
    rows = pages.select(F.explode(F.from_json("body", f"map<string,array<{kind}>>")).alias("package", "advisories")).select("package", F.explode("advisories").alias("a"))
    ids = extract_identifiers(F.concat_ws(" ", "a.url", "a.title", F.array_join("a.cves", " ")))
    ghsa = F.coalesce(F.try_element_at(F.filter(ids, lambda i: i.startswith("GHSA-")), F.lit(1)), F.concat(F.lit("NPM-"), "a.id"))
    package = F.struct(F.lit("npm").alias("ecosystem"), F.col("package").alias("name"))
    vulnerable = F.struct(package.alias("package"), F.col("a.vulnerable_versions").alias("vulnerable_version_range"), F.col("a.patched_versions").alias("first_patched_version"))
    cwes = F.transform(F.coalesce("a.cwe", F.array().cast("array<string>")), lambda c: F.struct(c.alias("cwe_id")))
    links = F.filter(F.array(F.struct(F.col("a.url").alias("url"))), lambda r: r["url"].isNotNull())
    named = F.transform("ids", lambda i: F.struct(F.substring_index(i, "-", 1).alias("type"), i.alias("value")))
    payload = F.struct(
        F.col("ghsa").alias("ghsa_id"), named.alias("identifiers"), F.col("a.severity").alias("severity"), F.col("a.title").alias("summary"), F.col("a.title").alias("description"), F.array(vulnerable).alias("vulnerabilities"), cwes.alias("cwes"), links.alias("references"),
    )
    rows = rows.withColumns({"ids": ids, "ghsa": ghsa})
    return rows.select(F.concat_ws("/", "package", "ghsa").alias("external_key"), F.col("ghsa").alias("external_id"), F.array_distinct(F.concat(F.array("ghsa"), "ids")).alias("identifiers"), F.to_json(payload).alias("payload_json"))
