"""The canonical catalog and its projections: A1-A8, A18, J1-J3, J5, J12, M8-M10, T1, D6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.identity import catalog_identifier
from vulnlake.functions.packages import present
from vulnlake.functions.text import index_tokens

# --- fixed values ---------------------------------------------------------
EXPLOIT_SOURCES = ["exploitdb", "poc-in-github", "nuclei-templates", "metasploit", "trickest-cve", "seebug"]
UNLINKED = "evidence-projection-unlinked-v1"
TITLE_FIRST = ["ghsa", "maven-advisory", "maven-osv", "osv"]
TITLE_SECOND = ["cve-list-v5", "nvd-cve", "cisa-kev"]
DESCRIPTION_FIRST = ["cve-list-v5", "nvd-cve"]
STATUS_FIRST = ["cve-list-v5", "nvd-cve", "cisa-kev"]
LATEST_ROWS = 5000
# --------------------------------------------------------------------------


def shown(records: DataFrame) -> DataFrame:
    """Records that are not suppressed."""
    return records.where(F.coalesce(F.col("normalizer_version"), F.lit("")) != UNLINKED)


def alias_owners(identifiers: DataFrame, records: DataFrame) -> DataFrame:
    """A5 with P1-P4, J5: ``identifier, vulnerability_id, vulnerability_key``.

    The owner of an identifier is the least key among shown records of other than
    exploit sources; a CVE id is only owned by its own key.
    """
    owning = identifiers.where(~F.col("source_code").isin(*EXPLOIT_SOURCES) & catalog_identifier(F.col("identifier"), F.col("vulnerability_key")))
    live = shown(records).select("source_code", "source_record_id").distinct()
    owning = owning.join(live, ["source_code", "source_record_id"], "left_semi")
    return owning.groupBy("identifier").agg(
        F.min_by("vulnerability_id", F.struct("vulnerability_key", "vulnerability_id")).alias("vulnerability_id"), F.min("vulnerability_key").alias("vulnerability_key")
    )


def _priority(first: list[str], second: list[str]) -> Column:
    source = F.col("source_code")
    return F.when(source.isin(*first), 0).when(source.isin(*second), 1).when(source.isin(*EXPLOIT_SOURCES), 9).otherwise(3)


def record_rollup(records: DataFrame) -> DataFrame:
    """A1 with P4, P5: one row per key with the best title, description and status.

    Best is the source of most priority, then the latest change as text, then the
    greatest record id, then the greatest value; blank values do not count.
    """
    changed = F.coalesce(F.col("modified_at"), F.col("published_at"), F.lit(""))

    def best(column: str, priority: Column) -> Column:
        order = F.struct(-priority, changed, F.col("source_record_id"), F.col("source_code"), F.col(column))
        usable = F.when(F.coalesce(F.col(column), F.lit("")) != "", order)
        return F.max_by(column, usable).alias(column)

    live = shown(records).where(F.col("source_code") != "nuclei-templates")
    return live.groupBy("vulnerability_id", "vulnerability_key").agg(
        best("title", _priority(TITLE_FIRST, TITLE_SECOND)),
        best("description", _priority(DESCRIPTION_FIRST, TITLE_FIRST)),
        best("status", _priority(STATUS_FIRST, [])),
        F.min(F.nullif(F.col("published_at"), F.lit(""))).alias("published_at"),
        F.max(F.nullif(F.col("modified_at"), F.lit(""))).alias("modified_at"),
        F.count("*").alias("source_count"),
    )


def severity_rollup(severity: DataFrame) -> DataFrame:
    """A2: greatest score per key and the label that goes with the greatest labelled one."""
    labelled = F.when(F.col("severity_label").isNotNull() & F.col("score").isNotNull(), F.struct("score", "severity_label"))
    return severity.groupBy("vulnerability_key").agg(F.max("score").alias("max_cvss_score"), F.max_by("severity_label", labelled).alias("severity_label"))


def display_name() -> Column:
    """Package name, else purl, else CPE name, else unknown."""
    return F.coalesce(F.nullif("package_name", F.lit("")), F.nullif("purl", F.lit("")), F.nullif("cpe23_uri", F.lit("")), F.lit("unknown"))


def _json(column: Column) -> Column:
    return F.to_json(F.sort_array(column))


def affected_rollup(components: DataFrame) -> DataFrame:
    """A3: distinct component names of a vulnerability, counted and as JSON."""
    name = F.col("display_name")
    return components.groupBy("vulnerability_id").agg(
        F.count_distinct(name).alias("affected_component_count"), _json(F.collect_set(name)).alias("affected_component_names_json")
    )


def identifier_rollup(identifiers: DataFrame, records: DataFrame) -> DataFrame:
    """A4: sorted distinct identifiers of a key as JSON, of those it may own."""
    kept = identifiers.where(~F.col("source_code").isin(*EXPLOIT_SOURCES) & catalog_identifier(F.col("identifier"), F.col("vulnerability_key")))
    live = shown(records).select("source_code", "source_record_id").distinct()
    kept = kept.join(live, ["source_code", "source_record_id"], "left_semi")
    return kept.groupBy("vulnerability_key").agg(_json(F.collect_set("identifier")).alias("identifiers_json"))


def scored_rollup(records: DataFrame, severity: DataFrame) -> DataFrame:
    """A1 with A2: the columns of the catalog that records and scores give."""
    base = record_rollup(records).withColumnRenamed("vulnerability_key", "primary_identifier").withColumnRenamed("vulnerability_id", "id")
    return base.join(severity_rollup(severity).withColumnRenamed("vulnerability_key", "primary_identifier"), "primary_identifier", "left")


def catalog(records: DataFrame, identifiers: DataFrame, severity: DataFrame, components: DataFrame, shown_in: DataFrame | None = None) -> DataFrame:
    """One catalog row per key; every input is grouped before the joins.

    ``shown_in`` has the records that decide whether an identifier is shown, where
    ``records`` is only a part of them.
    """
    out = scored_rollup(records, severity)
    out = out.join(affected_rollup(components).withColumnRenamed("vulnerability_id", "id"), "id", "left")
    out = out.join(identifier_rollup(identifiers, records if shown_in is None else shown_in).withColumnRenamed("vulnerability_key", "primary_identifier"), "primary_identifier", "left")
    return out.fillna({"affected_component_count": 0, "affected_component_names_json": "[]", "identifiers_json": "[]"})


def _keyed(facts: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    return facts.where("vulnerable").join(
        vulnerabilities.select(F.col("id").alias("vulnerability_id"), F.col("primary_identifier").alias("vulnerability_key")), "vulnerability_key"
    )


def _plain_purl() -> Column:
    return F.regexp_replace(F.substring_index(F.substring_index("purl", "#", 1), "?", 1), "@[^/@]*$", "")


def affected_facts(facts: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """What matching reads of ``affected_components``, not grouped: rows may repeat."""
    return _keyed(facts, vulnerabilities).select(
        "vulnerability_id", "ecosystem", "package_name", F.lower(display_name()).alias("display_name_lower"), _plain_purl().alias("purl_without_version"),
        "cpe23_uri", F.col("version_range_raw").alias("normalized_range"), "range_type",
    )


def affected_components(facts: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """A6, J2 with P6, P21: vulnerable facts grouped into components of catalog rows."""
    grouped = _keyed(facts, vulnerabilities).groupBy(
        "vulnerability_id", "source_code", "ecosystem", "package_name", "purl", "cpe23_uri", F.col("version_range_raw").alias("normalized_range"), "range_type"
    ).agg(F.count("*").cast("int").alias("evidence_count"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return grouped.withColumns(
        {
            "id": F.md5(F.concat_ws("|", "vulnerability_id", *(blank(c) for c in ("source_code", "ecosystem", "package_name", "purl", "cpe23_uri", "normalized_range")))),
            "display_name": display_name(),
            "purl_without_version": _plain_purl(),
            "confidence": F.when(F.col("cpe23_uri") != "", 1.0).when(F.col("purl") != "", 0.95).otherwise(0.8),
            "ecosystem_lower": F.lower("ecosystem"),
            "package_name_lower": F.lower("package_name"),
            "display_name_lower": F.lower(display_name()),
        }
    )


def components_from_keys(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """Components of a map of keys; nameless facts dropped, the source not in the key."""
    named = facts.where("vulnerable").where(F.coalesce(present(F.col("package_name")), present(F.col("purl")), present(F.col("cpe23_uri"))).isNotNull())
    keyed = named.withColumn("k", F.upper("vulnerability_key")).join(keys.select(F.upper("vulnerability_key").alias("k"), "vulnerability_id"), "k")
    grouped = keyed.groupBy("vulnerability_id", "ecosystem", "package_name", "purl", "cpe23_uri", F.col("version_range_raw").alias("normalized_range"), "range_type").agg(
        F.count("*").cast("int").alias("evidence_count")
    )
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return grouped.withColumns(
        {
            "id": F.md5(F.concat_ws("|", "vulnerability_id", *(blank(c) for c in ("ecosystem", "package_name", "purl", "cpe23_uri", "normalized_range", "range_type")))),
            "display_name": display_name(),
            "confidence": F.lit(1.0),
            "resolution_status": F.lit("candidate"),
        }
    )


def component_summary(components: DataFrame) -> DataFrame:
    """Components of a vulnerability, with their ecosystems and names."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit("")))), "|")
    return components.groupBy("vulnerability_id").agg(F.count("*").alias("component_count"), joined("ecosystem_lower").alias("ecosystems"), joined("display_name_lower").alias("names"))


def component_catalog(components: DataFrame) -> DataFrame:
    """Components of the whole catalog by ecosystem and name, with their addresses."""
    return components.groupBy("ecosystem", "display_name").agg(
        F.max("purl").alias("primary_purl"), F.max("cpe23_uri").alias("primary_cpe23_uri"), F.count_distinct("vulnerability_id").alias("vulnerability_count")
    ).withColumn("component_type", F.when(F.col("primary_cpe23_uri").isNotNull() & F.col("primary_purl").isNull(), "cpe").otherwise("package"))


def search_tokens(vulnerabilities: DataFrame) -> DataFrame:
    """the inverted index ``vulnerability_id, token``."""
    tokens = index_tokens(F.col("primary_identifier"), F.col("title"), F.col("identifiers_json"))
    return vulnerabilities.select(F.col("id").alias("vulnerability_id"), F.explode(tokens).alias("token"))


def latest(vulnerabilities: DataFrame, rows: int = LATEST_ROWS) -> DataFrame:
    """The most recently changed rows, nulls last."""
    return vulnerabilities.orderBy(F.col("modified_at").desc_nulls_last(), F.col("id").desc()).limit(rows)


def impacted_identifiers(owners: DataFrame, identifiers: DataFrame, keys: DataFrame) -> DataFrame:
    """Identifiers that changed keys own now or name in their records."""
    changed = keys.select("vulnerability_key").distinct()
    return (
        owners.join(changed, "vulnerability_key", "left_semi").select("identifier")
        .unionByName(identifiers.join(changed, "vulnerability_key", "left_semi").select("identifier"))
        .distinct()
    )


def rebuild_owners(owners: DataFrame, identifiers: DataFrame, records: DataFrame, keys: DataFrame) -> DataFrame:
    """Owners after the records of ``keys`` changed.

    Identifiers the keys owned before or name now are elected again; all other
    rows stay. Equals a full election.
    """
    impacted = impacted_identifiers(owners, identifiers, keys)
    again = alias_owners(identifiers.join(impacted, "identifier", "left_semi"), records)
    return owners.join(impacted, "identifier", "left_anti").unionByName(again)


def rebuild_catalog(previous: DataFrame, records: DataFrame, identifiers: DataFrame, severity: DataFrame, components: DataFrame, keys: DataFrame) -> DataFrame:
    """M9: the catalog with the rows of ``keys`` made anew, all others kept."""
    changed = keys.select("vulnerability_key").distinct()
    part = lambda df: df.join(changed, "vulnerability_key", "left_semi")
    ids = part(records).select("vulnerability_id").distinct()
    fresh = catalog(part(records), part(identifiers), part(severity), components.join(ids, "vulnerability_id", "left_semi"), records)
    kept = previous.join(changed.withColumnRenamed("vulnerability_key", "primary_identifier"), "primary_identifier", "left_anti")
    return kept.unionByName(fresh)
