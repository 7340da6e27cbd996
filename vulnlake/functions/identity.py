"""Identifiers as column expressions: F1-F6, F50, P1, P2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
EXACT_CVE = "^CVE-[0-9]{4}-[0-9]{4,}$"
ADVISORY_ID = "^[A-Z][A-Z0-9_.]*-[A-Z0-9][A-Z0-9_.:-]*$"
EMBEDDED_CVE = "^[A-Z][A-Z0-9_.-]*-(CVE-[0-9]{4}-[0-9]{4,})$"
CATALOG_ID = "^(CVE-[0-9]{4}-[0-9]{4,}|[A-Z][A-Z0-9_.]*-[A-Z0-9][A-Z0-9_.:-]*)$"
ID_TYPES = ["CVE", "GHSA", "PYSEC", "RUSTSEC", "ASB", "OSV", "UBUNTU", "CNNVD", "CNVD", "SSV", "AVD", "CT", "NSFOCUS", "CERT360"]
OWNING_PREFIXES = ["GHSA-", "BDSA-"]
# --------------------------------------------------------------------------


def normalize(value: Column) -> Column:
    """trimmed of white space and upper case."""
    return F.upper(F.trim(value, F.lit(" \t\r\n\f\u000b\u00a0\u3000")))


def is_cve(value: Column) -> Column:
    """a whole CVE id, in any case; false for null."""
    return F.coalesce(normalize(value).rlike(EXACT_CVE), F.lit(False))


def is_vulnerability_id(value: Column) -> Column:
    """4 to 160 characters, a CVE id or an advisory id; false for null."""
    norm = normalize(value)
    form = F.when(norm.startswith("CVE-"), norm.rlike(EXACT_CVE)).otherwise(norm.rlike(ADVISORY_ID))
    return F.coalesce(F.length(norm).between(4, 160) & form, F.lit(False))


def embedded_cve(value: Column) -> Column:
    """the CVE a prefixed id ends with, or null; a bare CVE id embeds none."""
    norm = normalize(value)
    return F.when(~norm.rlike(EXACT_CVE), F.nullif(F.regexp_extract(norm, EMBEDDED_CVE, 1), F.lit("")))


def _starts(prefix: str):
    return lambda value: value.startswith(prefix)


def resolve_canonical(own: Column, identifiers: Column) -> Column:
    """the canonical identity of a record from its own id and direct aliases."""
    mine = normalize(own)
    known = F.array_distinct(F.concat(F.filter(F.transform(F.coalesce(identifiers, F.array().cast("array<string>")), normalize), is_vulnerability_id), F.array(mine)))
    cve_of = lambda v: F.when(v.rlike(EXACT_CVE), v).otherwise(embedded_cve(v))
    cves = F.array_distinct(F.filter(F.transform(known, cve_of), lambda v: v.isNotNull()))
    owner = mine
    for prefix in reversed(OWNING_PREFIXES):
        with_prefix = F.filter(known, _starts(prefix))
        owner = (
            F.when(mine.startswith(prefix) & is_vulnerability_id(mine), mine)
            .when(F.size(with_prefix) == 1, F.element_at(with_prefix, 1))
            .otherwise(owner)
        )
    return (
        F.when(embedded_cve(mine).isNotNull(), embedded_cve(mine))
        .when(is_cve(mine), mine)
        .when(F.size(cves) == 1, F.try_element_at(cves, F.lit(1)))
        .when(F.size(cves) > 1, mine)
        .otherwise(owner)
    )


def _guid(text: Column) -> Column:
    """SHA-256 of a text as a version-5-shaped GUID in mixed byte order."""
    digest = F.sha2(text, 256)
    byte = lambda n: F.substring(digest, 2 * n + 1, 2)
    low = F.lpad(F.lower(F.hex(F.conv(F.substring(digest, 13, 2), 16, 10).cast("int").bitwiseAND(15).bitwiseOR(80))), 2, "0")
    variant = F.lpad(F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128))), 2, "0")
    return F.concat(
        byte(3), byte(2), byte(1), byte(0), F.lit("-"), byte(5), byte(4), F.lit("-"), byte(7), low, F.lit("-"), variant, byte(9), F.lit("-"), F.substring(digest, 21, 12)
    )


def vulnerability_guid(key: Column) -> Column:
    """the id of a vulnerability key."""
    return _guid(F.concat(F.lit("vulnerability:"), normalize(key)))


def raw_guid(source: Column, key: Column) -> Column:
    """the id of a raw record of a source."""
    return _guid(F.concat(F.lit("raw:"), source, F.lit(":"), key))


def identifier_type(value: Column) -> Column:
    """the family of an id, OTHER if none."""
    norm = normalize(value)
    kind = F.when(norm.rlike("^CWE-[0-9]+$"), "CWE").otherwise("OTHER")
    for name in reversed(ID_TYPES):
        kind = F.when(norm.startswith(f"{name}-"), name).otherwise(kind)
    return kind


def preferred_identifier(identifiers: Column, own: Column) -> Column:
    """First CVE, else first GHSA, else first id, else the own id."""
    first = lambda prefix: F.try_element_at(F.filter(identifiers, lambda v: v.startswith(prefix)), F.lit(1))
    return F.coalesce(first("CVE-"), first("GHSA-"), F.try_element_at(identifiers, F.lit(1)), own)


def catalog_identifier(identifier: Column, key: Column) -> Column:
    """A valid id that a record of ``key`` may own in the catalog."""
    return identifier.rlike(CATALOG_ID) & (~identifier.startswith("CVE-") | (identifier == key))
