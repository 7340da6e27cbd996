"""Evidence bundles and display rows: N26-N28, D13, D15, D16, F52, F53, A29."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.text import alias_rank, is_fix_reference, url_domain
from vulnlake.operators.evidence import place_in_groups, top_facts, top_per_key, top_references, top_severity, top_weaknesses

#: Rows of each block of a bundle, and characters of a whole bundle: features of N26.
BUNDLE_CAPS = {"facts": 50, "severity": 12, "references": 40, "weaknesses": 20}
BUNDLE_CHARS = 24_000
#: Reference triage keeps so many.
TRIAGE = 12


def _block(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The rows of a block as one sorted array per key (at most its cap)."""
    return rows.groupBy("vulnerability_key").agg(F.sort_array(F.collect_list(F.struct(F.col("rn"), *columns))).alias(name))


def evidence_bundles(catalog: DataFrame, facts: DataFrame, severity: DataFrame, references: DataFrame, weaknesses: DataFrame, budget: int = BUNDLE_CHARS) -> DataFrame:
    """``vulnerability_key, input_json, input_chars, evidence_hash``: the evidence
    of each catalog row in fixed order, cut to a budget of characters.

    Blocks are halved together until the text fits, at most six times; then a bundle
    keeps its head only. Keys without evidence get empty blocks.
    """
    blocks = {
        "facts": (top_facts(facts, BUNDLE_CAPS["facts"]), ["source_code", "ecosystem", "package_name", "version_range_raw"]),
        "severity": (top_severity(severity, BUNDLE_CAPS["severity"]), ["source_code", "vector_string", "score", "severity_label"]),
        "references": (top_references(references, BUNDLE_CAPS["references"]).withColumn("domain", url_domain(F.col("url"))), ["source_code", "url", "domain"]),
        "weaknesses": (top_weaknesses(weaknesses, BUNDLE_CAPS["weaknesses"]), ["source_code", "weakness_id"]),
    }
    out = catalog.select(F.col("primary_identifier").alias("vulnerability_key"), "title", "description", "status")
    for name, (rows, columns) in blocks.items():
        out = out.join(_block(rows, name, columns), "vulnerability_key", "left")
    head = F.struct("vulnerability_key", "title", F.substring(F.coalesce("description", F.lit("")), 1, budget // 4).alias("description"), "status")

    def text(step: int) -> Column:
        kept = [F.slice(F.col(n), 1, max(1, BUNDLE_CAPS[n] >> step)).alias(n) for n in blocks]
        return F.to_json(F.struct(head.alias("vulnerability"), *kept))

    steps = [text(step) for step in range(6)]
    fitting = F.lit(None).cast("string")
    for candidate in reversed(steps):
        fitting = F.when(F.length(candidate) <= budget, candidate).otherwise(fitting)
    out = out.withColumn("input_json", F.coalesce(fitting, F.to_json(F.struct(head.alias("vulnerability")))))
    return out.select("vulnerability_key", "input_json", F.length("input_json").cast("bigint").alias("input_chars"), F.sha2("input_json", 256).alias("evidence_hash"))


def cached_analyses(bundles: DataFrame, analyses: DataFrame, prompt_version: str) -> DataFrame:
    """The latest analysis per vulnerability, if it has the prompt version and the
    hash of the present evidence."""
    latest = analyses.groupBy("vulnerability_key").agg(F.max_by(F.struct("prompt_version", "evidence_hash", "analysis_json"), "updated_at").alias("a"))
    joined = bundles.select("vulnerability_key", "evidence_hash").join(latest, "vulnerability_key", "left")
    valid = (F.col("a.prompt_version") == prompt_version) & (F.col("a.evidence_hash") == F.col("evidence_hash"))
    return joined.select("vulnerability_key", F.coalesce(valid, F.lit(False)).alias("is_cached"), F.when(valid, F.col("a.analysis_json")).alias("analysis_json"))


def response_object(content: Column) -> Column:
    """The JSON object of a response, without code fences; null if it is none."""
    plain = F.trim(content)
    inner = F.when(plain.startswith("```"), F.regexp_extract(plain, r"(?s)^```[^\n]*\n(.*)```", 1)).otherwise(plain)
    parsed = F.try_parse_json(F.trim(inner))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed))


def grouped_descriptions(records: DataFrame) -> DataFrame:
    """Descriptions of a key without repeats (white space folded, case ignored),
    with the sources that give them, longest first."""
    folded = F.lower(F.trim(F.regexp_replace("description", r"\s+", " ")))
    named = records.withColumn("folded", folded).where("folded <> ''")
    groups = named.groupBy("vulnerability_key", "folded").agg(F.min("description").alias("description"), F.array_join(F.sort_array(F.collect_set("source_code")), ",").alias("sources"))
    return place_in_groups(groups, "vulnerability_key", [F.length("folded").desc(), F.col("folded").asc()]).drop("folded")


def headlines(records: DataFrame) -> DataFrame:
    """The headline of a key: trusted advisories first, poor texts last, then the
    shorter title; ties by text."""
    title = F.trim(F.coalesce(F.col("title"), F.lit("")))
    source = F.when(F.col("source_code").isin("ghsa", "osv", "npm-advisory"), 30).when(F.col("source_code").isin("nvd-cve", "cve-list-v5"), 20).otherwise(10)
    poor = F.when((F.length(title) < 12) | title.rlike(r"(?i)^(untitled|unknown|n/a|cve-\d+-\d+)$"), 25).otherwise(0)
    scored = records.where(title != "").withColumn("title", title).withColumn("score", source - poor)
    best = scored.groupBy("vulnerability_key").agg(F.min(F.struct((-F.col("score")).alias("s"), F.length("title").alias("n"), "title")).alias("b"))
    return best.select("vulnerability_key", F.col("b.title").alias("headline"))


def ranked_aliases(identifiers: DataFrame) -> DataFrame:
    """Identifiers of a key by family, then by name."""
    distinct = identifiers.select("vulnerability_key", "identifier").distinct().withColumn("family", alias_rank(F.col("identifier")))
    return place_in_groups(distinct, "vulnerability_key", [F.col("family").asc(), F.col("identifier").asc()]).drop("family")


def triaged_references(references: DataFrame, limit: int = TRIAGE) -> DataFrame:
    """of a key's references those about fixes, the first twelve; all of them
    (also the first twelve) where none is."""
    marked = references.withColumn("fix", is_fix_reference(F.col("url"), F.col("ref_type")))
    fixed = marked.groupBy("vulnerability_key").agg(F.max("fix").alias("any_fix"))
    kept = marked.join(fixed, "vulnerability_key").where("fix or not any_fix").drop("any_fix", "fix")
    return top_per_key(kept.select("vulnerability_key", "url").distinct(), "vulnerability_key", [F.col("url").asc()], limit)


def relation_groups(relations: DataFrame) -> DataFrame:
    """related identifiers of a key under Upstream, Related and Downstream."""
    out = relations.select("vulnerability_key", F.initcap("relation_type").alias("label"), F.upper("related_identifier").alias("identifier"))
    back = relations.where("relation_type = 'upstream'").select(F.upper("related_identifier").alias("vulnerability_key"), F.lit("Downstream").alias("label"), F.col("vulnerability_key").alias("identifier"))
    return out.unionByName(back).where("vulnerability_key <> identifier").distinct()
