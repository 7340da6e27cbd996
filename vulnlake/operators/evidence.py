"""Evidence reads: top rows per key, merges over alias keys, relations. W1-W7, D1-D8, D14, T5, T9, J4, A28, A29, U2, P14."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.session import input_partitions, reliable_checkpoint

#: Row caps of the blocks of a detail page: the feature of T5.
DETAIL_CAPS = {
    "components": 200, "facts": 250, "severity": 40, "references": 160, "weaknesses": 80, "records": 120, "descriptions": 40,
    "exploits": 40, "threat": 20, "downstream": 500, "relations": 1000,
}


def top_per_key(df: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows per key; the order must be total."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rn", place.cast("bigint")).where(F.col("rn") <= limit)


def place_in_groups(df: DataFrame, key: str, order: list[Column], name: str = "rn") -> DataFrame:
    """The place of every row in its group, of which no task holds all: rows are
    range-partitioned by key and order, numbered where they lie, and shifted by
    the rows of their group in the partitions before. The order must be total."""
    spread = df.repartitionByRange(input_partitions(df), F.col(key).asc(), *order).sortWithinPartitions(F.col(key).asc(), *order)
    numbered = reliable_checkpoint(spread.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    runs = numbered.groupBy(key, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = runs.select(F.col(key).alias("__key"), F.col("__part").alias("__run"), (F.coalesce(before, F.lit(0)) + 1 - F.col("__first")).alias("__shift"))
    joined = numbered.join(shifts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__run")))
    return joined.withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__key", "__run", "__shift")


def _has(column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) != "", 0).otherwise(1).asc()


def _tail(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def top_facts(facts: DataFrame, limit: int = 200) -> DataFrame:
    """Facts per key, those with a CPE name first, then with a purl."""
    order = [_has("cpe23_uri"), _has("purl"), *_tail("source_code", "package_name", "raw_index_id", "line")]
    return top_per_key(facts, "vulnerability_key", order, limit)


def top_references(references: DataFrame, limit: int = 160) -> DataFrame:
    """References per key by source and address."""
    return top_per_key(references, "vulnerability_key", _tail("source_code", "url", "source_record_id", "raw_index_id"), limit)


def top_severity(severity: DataFrame, limit: int = 40) -> DataFrame:
    """Scores per key, with a vector first, then the highest; the first is selected."""
    order = [_has("vector_string"), F.col("score").desc_nulls_last(), *_tail("source_code", "raw_index_id", "line")]
    return top_per_key(severity, "vulnerability_key", order, limit).withColumn("is_selected", F.col("rn") == 1)


def top_weaknesses(weaknesses: DataFrame, limit: int = 80) -> DataFrame:
    """Weaknesses per key, those with an id first."""
    return top_per_key(weaknesses, "vulnerability_key", [_has("weakness_id"), *_tail("weakness_id", "source_code", "source_record_id")], limit)


def top_components(components: DataFrame, limit: int = 60) -> DataFrame:
    """Components per vulnerability, by kind of range, then those with a range."""
    kind = F.when(F.lower("range_type").isin("ecosystem", "semver"), 0).otherwise(1).asc()
    order = [kind, _has("normalized_range"), *_tail("ecosystem", "display_name", "id", "range_type", "source_code")]
    return top_per_key(components, "vulnerability_id", order, limit)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, keys compared without case; rows with
    equal keys are pre-aggregated on the map side."""
    folded = {f"__k{n}": F.lower(F.coalesce(F.col(k).cast("string"), F.lit(""))) for n, k in enumerate(keys)}
    row = F.struct(*df.columns)
    last = df.withColumns(folded).groupBy(*folded).agg(F.max_by(row, F.struct(*order)).alias("r"))
    return last.select("r.*")


def distinct_facts(facts: DataFrame) -> DataFrame:
    """D3: one fact per record and 8-field fingerprint."""
    return facts.dropDuplicates(
        ["source_code", "source_record_id", "fact_type", "ecosystem", "package_name", "purl", "cpe23_uri", "version_range_raw", "range_type", "vulnerable"]
    )


def distinct_references(references: DataFrame) -> DataFrame:
    """One reference per record and address, without case; blank ones dropped."""
    return keep_first(references.where(F.trim("url") != ""), ["source_code", "source_record_id", "url"], ["raw_index_id"])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key, keys compared without case."""
    folded = {f"__k{n}": F.lower(F.coalesce(F.col(k).cast("string"), F.lit(""))) for n, k in enumerate(keys)}
    first = df.withColumns(folded).groupBy(*folded).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return first.select("r.*")


def distinct_weaknesses(weaknesses: DataFrame) -> DataFrame:
    """One weakness per record, type and id; those without id dropped."""
    return weaknesses.where(F.coalesce(F.col("weakness_id"), F.lit("")) != "").dropDuplicates(["source_code", "source_record_id", "weakness_type", "weakness_id"])


def merge_alias_rows(rows: DataFrame, keys: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Rows of several keys as one list without repeats, in order of the
    keys; ``keys(group_id, vulnerability_key, key_place)``; the first ``limit`` rows."""
    mine = rows.join(keys, "vulnerability_key")
    first = mine.groupBy("group_id", *columns).agg(F.min("key_place").alias("key_place"))
    return top_per_key(first, "group_id", [F.col("key_place").asc(), *_tail(*columns)], limit)


def compact_severity(severity: DataFrame) -> DataFrame:
    """One row per key and 6 fields, with the number of sources."""
    fields = ["vulnerability_key", "scoring_system", "scoring_version", "vector_string", "score", "severity_label"]
    return severity.groupBy(*fields).agg(F.count_distinct("source_code").alias("source_count"))


def sweep_duplicates(exploits: DataFrame) -> DataFrame:
    """Of active rows with one raw id only the last changed stays active."""
    place = F.row_number().over(Window.partitionBy("source_code", "raw_index_id").orderBy(F.coalesce(F.col("modified_at"), F.lit("")).desc(), F.col("exploit_row").desc()))
    active = exploits.where(F.coalesce(F.col("is_active"), F.lit(True))).withColumn("is_active", place == 1)
    return active.unionByName(exploits.where(~F.coalesce(F.col("is_active"), F.lit(True))))


def relation_references(relations: DataFrame, records: DataFrame) -> DataFrame:
    """Outgoing and incoming relations of keys, without self relations."""
    joined = relations.join(records.select("source_code", "source_record_id").distinct(), ["source_code", "source_record_id"])
    outgoing = joined.select("vulnerability_key", F.lit("out").alias("direction"), "relation_type", F.col("related_identifier").alias("other"))
    incoming = joined.select(F.col("related_identifier").alias("vulnerability_key"), F.lit("in").alias("direction"), "relation_type", F.col("vulnerability_key").alias("other"))
    return outgoing.unionByName(incoming).where("vulnerability_key <> other").distinct()


def relation_sets(relations: DataFrame) -> DataFrame:
    """Sorted upstream and related identifiers of a key."""
    of = lambda kind: F.to_json(F.sort_array(F.collect_set(F.when(F.col("relation_type") == kind, F.upper("related_identifier")))))
    return relations.groupBy("vulnerability_key").agg(of("upstream").alias("upstream_json"), of("related").alias("related_json"))


def source_urls(records: DataFrame) -> DataFrame:
    """The first link per key and source."""
    linked = records.where(F.trim("source_url") != "")
    return linked.groupBy("vulnerability_key", "source_code").agg(F.min_by("source_url", F.struct("source_record_id", "source_url")).alias("source_url"))


def exploits_of(exploits: DataFrame, key: str, exact: bool = False) -> DataFrame:
    """Active exploits that name a key; as text (which also finds longer
    ids that begin with it), or ``exact``."""
    active = exploits.where(F.coalesce(F.col("is_active"), F.lit(True)))
    if exact:
        return active.where(F.col("identifiers").rlike(rf"(?<![A-Za-z0-9-]){key}(?![A-Za-z0-9-])"))
    return active.where(F.col("identifiers").contains(key))


def detail(tables: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """T5: the blocks of a detail page, each with its fixed cap (DETAIL_CAPS)."""
    mine = {name: df.where(F.col("vulnerability_key") == key) for name, df in tables.items() if "vulnerability_key" in df.columns}
    out = {}
    for name, make in (("facts", top_facts), ("severity", top_severity), ("references", top_references), ("weaknesses", top_weaknesses)):
        if name in mine:
            out[name] = make(mine[name], DETAIL_CAPS[name])
    if "records" in mine:
        out["records"] = mine["records"].orderBy("source_code", "source_record_id").limit(DETAIL_CAPS["records"])
        described = mine["records"].where(F.trim("description") != "").select("source_code", "description").distinct()
        out["descriptions"] = described.orderBy(F.length("description").desc(), "source_code", "description").limit(DETAIL_CAPS["descriptions"])
    if "relations" in mine:
        out["relations"] = mine["relations"].orderBy("relation_type", "related_identifier", "source_code", "source_record_id").limit(DETAIL_CAPS["relations"])
    if "threat" in mine:
        out["threat"] = mine["threat"].orderBy("score_type", "source_code").limit(DETAIL_CAPS["threat"])
    if "exploits" in tables:
        out["exploits"] = exploits_of(tables["exploits"], key).orderBy("source_code", "exploit_row").limit(DETAIL_CAPS["exploits"])
    return out


def projection_state(records: DataFrame, facts: DataFrame, source: str) -> tuple[DataFrame, bool]:
    """Distinct keys of a source, and whether it has affected facts: what a reset
    of the source has to rebuild."""
    mine = lambda df: df.where(F.lower("source_code") == source.lower())
    return mine(records).select("vulnerability_key").distinct(), not mine(facts).isEmpty()


def affected_keys(facts: DataFrame, raw_ids: DataFrame | None = None) -> DataFrame:
    """Distinct keys of all facts, or of those with given raw ids."""
    kept = facts if raw_ids is None else facts.join(raw_ids.select("raw_index_id"), "raw_index_id", "left_semi")
    return kept.select("vulnerability_key").distinct()
