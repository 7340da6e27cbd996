"""Next states of tables: M1-M7, M11-M17, P16, P25, J7, J13, A30.

Tables are immutable: an operator gives the next state, and the store (see
``plans.store``) publishes it. Changes are found by joins on keys; all rows of
other keys pass through unshuffled where the join can broadcast the keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.operators.quality import bad_scores, repeated


def differs(left: str, right: str, columns: list[str]) -> Column:
    """Any column distinct, nulls equal."""
    return reduce(lambda a, b: a | b, (~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def replace_by_keys(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the incoming keys replaced, all others kept."""
    touched = incoming.select(*keys).distinct()
    return current.join(touched, keys, "left_anti").unionByName(incoming.select(*current.columns))


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet added, one per key (the least by
    values); rows with a null in the key are never added."""
    known = incoming.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    one = known.groupBy(*keys).agg(F.min(F.struct(*(c for c in known.columns if c not in keys))).alias("__r")).select(*keys, "__r.*")
    return current.unionByName(one.join(current.select(*keys), keys, "left_anti").select(*current.columns))


def reset_source(current: DataFrame, source: str, incoming: DataFrame | None = None) -> DataFrame:
    """M3: rows of a source dropped, then the new ones appended."""
    kept = current.where(~F.col("source_code").eqNullSafe(F.lit(source)))
    return kept if incoming is None else kept.unionByName(incoming.select(*current.columns))


def changed_records(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming records to write: forced, without hash, new, or with another
    hash or normalizer version."""
    have = current.select(
        F.lower("source_code").alias("s"), F.lower("source_record_id").alias("r"), F.col("record_hash").alias("old_hash"),
        F.coalesce(F.col("normalizer_version"), F.lit("")).alias("old_version"), F.lit(True).alias("known"),
    )
    joined = incoming.join(have, (F.lower("source_code") == F.col("s")) & (F.lower("source_record_id") == F.col("r")), "left")
    same = F.col("known") & (F.col("old_hash") == F.col("record_hash")) & (F.col("old_version") == F.coalesce(F.col("normalizer_version"), F.lit("")))
    forced = F.coalesce(F.col("force_normalize"), F.lit(False)) if "force_normalize" in incoming.columns else F.lit(False)
    write = forced | (F.trim(F.coalesce(F.col("record_hash"), F.lit(""))) == "") | ~F.coalesce(same, F.lit(False))
    return joined.where(write).select(*incoming.columns)


def score_delta(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """``vulnerability_key, score, percentile, observed_at, change`` with
    change in inserted, updated, unchanged or absent; absent rows stay, and only
    changed rows take the new time of observation."""
    c, n = current.alias("c"), incoming.alias("n")
    both = c.join(n, F.col("c.vulnerability_key") == F.col("n.vulnerability_key"), "full_outer")
    change = (
        F.when(F.col("c.vulnerability_key").isNull(), "inserted").when(F.col("n.vulnerability_key").isNull(), "absent")
        .when(differs("c", "n", ["score", "percentile"]), "updated").otherwise("unchanged")
    )
    pick = lambda col: F.when(change.isin("inserted", "updated"), F.col(f"n.{col}")).otherwise(F.col(f"c.{col}")).alias(col)
    key = F.coalesce(F.col("n.vulnerability_key"), F.col("c.vulnerability_key")).alias("vulnerability_key")
    return both.select(key, pick("score"), pick("percentile"), pick("observed_at"), change.alias("change"))


def merge_scores(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """M4: next state and counts; a feed with any bad or repeated row is refused."""
    if not bad_scores(incoming).isEmpty() or not repeated(incoming, "vulnerability_key").isEmpty():
        raise ValueError("the score feed has invalid or repeated rows")
    delta = score_delta(current, incoming)
    counts = {r["change"]: r["n"] for r in delta.groupBy("change").agg(F.count("*").alias("n")).toLocalIterator()}
    return delta.drop("change"), {k: counts.get(k, 0) for k in ("inserted", "updated", "unchanged", "absent")}


#: Columns whose change rewrites an exploit row.
EXPLOIT_COLUMNS = ["source_key", "identifiers", "title", "source_url", "artifact_type", "exploit_type", "maturity", "verification_status", "published_at", "modified_at"]


def upsert_exploits(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """M6: rows of the incoming raw ids take their values where any differs or the
    row was inactive; new ones are added; a missing snapshot id keeps the old one."""
    keys = ["source_code", "raw_index_id"]
    c, n = current.alias("c"), incoming.alias("n")
    both = c.join(n, (F.col("c.source_code") == F.col("n.source_code")) & (F.col("c.raw_index_id") == F.col("n.raw_index_id")), "full_outer")
    present = F.col("n.raw_index_id").isNotNull()
    key = [F.coalesce(F.col(f"n.{k}"), F.col(f"c.{k}")).alias(k) for k in keys]
    values = [F.when(present, F.col(f"n.{v}")).otherwise(F.col(f"c.{v}")).alias(v) for v in EXPLOIT_COLUMNS]
    snapshot = F.when(present, F.coalesce(F.col("n.snapshot_id"), F.col("c.snapshot_id"))).otherwise(F.col("c.snapshot_id")).alias("snapshot_id")
    active = F.when(present, F.lit(True)).otherwise(F.coalesce(F.col("c.is_active"), F.lit(True))).alias("is_active")
    return both.select(*key, *values, snapshot, active)


def apply_snapshot(current: DataFrame, incoming: DataFrame, source: str, snapshot_id: str, least_share: float = 0.5, override: bool = False) -> DataFrame:
    """M5: a full snapshot of a source: upserts its entries and switches off all
    others of the source.

    Refused (ValueError) if the snapshot id is blank, the snapshot is empty, has
    another source or repeated ids, or has fewer than ``least_share`` of the
    entries now active, unless overridden.
    """
    if not snapshot_id or not snapshot_id.strip():
        raise ValueError("blank snapshot id")
    stats = incoming.agg(F.count("*").alias("n"), F.count_distinct("raw_index_id").alias("ids"), F.count_if(~F.col("source_code").eqNullSafe(F.lit(source))).alias("foreign")).first()
    mine = current.where(F.col("source_code") == source)
    active = mine.where(F.coalesce(F.col("is_active"), F.lit(True))).count()
    if not stats["n"] or stats["foreign"] or stats["n"] != stats["ids"]:
        raise ValueError("empty, mixed or repeated snapshot")
    if not override and stats["n"] < active * least_share:
        raise ValueError("the snapshot is far smaller than the active set")
    stamped = incoming.withColumn("snapshot_id", F.lit(snapshot_id))
    merged = upsert_exploits(mine, stamped)
    now = merged.withColumn("is_active", F.col("snapshot_id").eqNullSafe(F.lit(snapshot_id)))
    return current.where(~F.col("source_code").eqNullSafe(F.lit(source))).select(*now.columns).unionByName(now)


def changed_keys(*tables: DataFrame) -> DataFrame:
    """Distinct keys of several batches."""
    return reduce(DataFrame.unionByName, (t.select("vulnerability_key") for t in tables)).distinct()


#: Changed keys from which a full rebuild costs less than a keyed one.
FULL_REBUILD = 50_000


def rebuild_kind(keys: DataFrame, threshold: int = FULL_REBUILD) -> str:
    """Full beyond the threshold, else keyed, none without keys."""
    n = keys.limit(threshold + 1).count()
    return "none" if n == 0 else "full" if n > threshold else "keyed"
