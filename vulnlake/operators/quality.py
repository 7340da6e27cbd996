"""Quality, coverage and audit aggregates: A9-A17, A19-A27, A31, A32, J9, J16, J17, U6, P20, P24."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
OPEN_LOWER_BOUND = r"^\s*>=?\s*0(\.0)*\s*$"
HAS_OPERATOR = "(<=|>=|==|=|<|>)"
# --------------------------------------------------------------------------


def ecosystem_packages(components: DataFrame, limit: int = 50) -> DataFrame:
    """Packages of every ecosystem with most vulnerabilities (a top-k report)."""
    grouped = components.groupBy("ecosystem_lower", "display_name").agg(F.count_distinct("vulnerability_id").alias("cves"), F.count("*").alias("components"))
    return grouped.orderBy(F.col("cves").desc(), "ecosystem_lower", "display_name").limit(limit)


def package_totals(components: DataFrame) -> DataFrame:
    """A10: packages over all ecosystems."""
    return components.groupBy("display_name").agg(
        F.count_distinct("vulnerability_id").alias("cves"), F.count_distinct("ecosystem_lower").alias("ecosystems"), F.count("*").alias("components")
    )


def matching_quality(facts: DataFrame) -> DataFrame:
    """How well facts of an ecosystem can be matched."""
    text = F.coalesce(F.col("version_range_raw"), F.lit(""))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return facts.groupBy(F.lower("ecosystem").alias("ecosystem")).agg(
        F.count("*").alias("facts"),
        F.count_distinct("vulnerability_key").alias("vulnerabilities"),
        count(F.col("purl") != "").alias("with_purl"),
        count(F.col("cpe23_uri") != "").alias("with_cpe"),
        count(text == "").alias("no_range"),
        count(text.rlike(OPEN_LOWER_BOUND)).alias("open_lower_bound"),
        count((text != "") & ~text.rlike(HAS_OPERATOR)).alias("unparseable"),
    )


def source_coverage(records: DataFrame) -> DataFrame:
    """Records, keys and the last change per source."""
    return records.groupBy("source_code").agg(
        F.count("*").alias("records"), F.count_distinct("vulnerability_key").alias("keys"), F.max(F.nullif(F.col("modified_at"), F.lit(""))).alias("last_modified")
    )


def ecosystem_coverage(facts: DataFrame) -> DataFrame:
    """Facts per ecosystem, those that are vulnerable and those with a range."""
    return facts.groupBy("ecosystem").agg(
        F.count("*").alias("facts"), F.count_if("vulnerable").alias("vulnerable_facts"),
        F.count_if(F.coalesce(F.col("version_range_raw"), F.lit("")) != "").alias("ranged_facts"),
    )


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def multi_owner_identifiers(identifiers: DataFrame) -> DataFrame:
    """Identifiers that records of several keys name."""
    return identifiers.groupBy("identifier").agg(F.count_distinct("vulnerability_key").alias("owners")).where("owners > 1")


def snapshot_stats(exploits: DataFrame) -> DataFrame:
    """Active rows and distinct raw ids per source."""
    active = exploits.where(F.coalesce(F.col("is_active"), F.lit(True)))
    return active.groupBy("source_code").agg(F.count("*").alias("active"), F.count_distinct("raw_index_id").alias("raw_ids"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def audit_catalog(vulnerabilities: DataFrame) -> DataFrame:
    """Rows, blank titles, blank descriptions and rows without affected components."""
    blank = lambda c: F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    return vulnerabilities.agg(
        F.count("*").alias("n_rows"), blank("title").alias("blank_titles"), blank("description").alias("blank_descriptions"),
        F.count_if(F.col("affected_component_count") == 0).alias("without_components"),
    )


def audit_relations(relations: DataFrame) -> DataFrame:
    """Self relations, repeats and blanks."""
    whole = F.concat_ws("|", "source_code", "source_record_id", "relation_type", "related_identifier")
    return relations.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("vulnerability_key") == F.col("related_identifier")).alias("self_relations"),
        (F.count("*") - F.count_distinct(whole)).alias("repeats"), F.count_if(F.trim("related_identifier") == "").alias("blanks"),
    )


def severity_distribution(vulnerabilities: DataFrame) -> DataFrame:
    """Catalog rows per label."""
    return vulnerabilities.groupBy(F.coalesce(F.col("severity_label"), F.lit("UNRATED")).alias("severity")).agg(F.count("*").alias("n_rows"))


def audit_gaps(vulnerabilities: DataFrame, **evidence: DataFrame) -> DataFrame:
    """Catalog rows without any row in each evidence table."""
    out = vulnerabilities.select("primary_identifier")
    for name, df in evidence.items():
        keys = df.select(F.col("vulnerability_key").alias("primary_identifier")).distinct().withColumn(f"has_{name}", F.lit(True))
        out = out.join(keys, "primary_identifier", "left")
    return out.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(f"has_{n}").isNull()).alias(f"without_{n}") for n in evidence))


def source_gaps(records: DataFrame) -> DataFrame:
    """Blank titles, descriptions and links per source."""
    blank = lambda c: F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    return records.groupBy("source_code").agg(F.count("*").alias("records"), blank("title").alias("blank_titles"), blank("description").alias("blank_descriptions"), blank("source_url").alias("blank_urls"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key the parent lacks, and repeated rows of a key."""
    have = parent.select(key).distinct().withColumn("__has", F.lit(True))
    return child.join(have, key, "left").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("__has").isNull()).alias("orphans"), (F.count(key) - F.count_distinct(key)).alias("repeats")
    )


def version_distribution(records: DataFrame) -> DataFrame:
    """Records per normalizer version."""
    return records.groupBy(F.coalesce(F.col("normalizer_version"), F.lit("none")).alias("normalizer_version")).agg(F.count("*").alias("records"))


def mismatched_owners(owners: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """Owner rows whose key is not that of their catalog row."""
    joined = owners.join(vulnerabilities.select(F.col("id").alias("vulnerability_id"), "primary_identifier"), "vulnerability_id")
    return joined.where("vulnerability_key <> primary_identifier").select("identifier", "vulnerability_key", "primary_identifier")


def sbom_quality(matches: DataFrame) -> DataFrame:
    """Findings per ecosystem by outcome, with the share that has a usable range.
    A row stands for ``n`` matches of its component."""
    eco = F.coalesce(F.lower("a_ecosystem"), F.lit("unknown"))
    no_range = F.coalesce(F.col("normalized_range"), F.lit("")) == ""
    number = lambda holds: F.sum(F.when(holds, F.col("n")).otherwise(0))
    return matches.groupBy(eco.alias("ecosystem")).agg(
        F.sum("n").alias("findings"), number(F.col("version_matched")).alias("affected"), number(~F.col("version_matched")).alias("not_affected"),
        number(F.col("version_matched").isNull()).alias("unknown"), number(no_range).alias("no_range"),
        F.count_distinct("component_id").alias("components_with_findings"),
        F.bround((F.sum("n") - number(no_range)) / F.sum("n"), 4).alias("actionable_range_ratio"),
    )


def compare_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids both sides report, and those only one does."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left_only").otherwise("right_only")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def counts_of(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Rows per value of an expression."""
    return df.groupBy(column.alias(name)).agg(F.count("*").alias("n_rows"))


def bad_scores(scores: DataFrame) -> DataFrame:
    """Score rows that make a feed invalid."""
    inside = lambda c: F.col(c).between(0.0, 1.0)
    good = F.col("vulnerability_key").rlike("^CVE-[0-9]{4}-[0-9]{4,}$") & inside("score") & inside("percentile")
    return scores.where(~F.coalesce(good, F.lit(False)))
