"""Incremental ingestion: X1-X10, X13 with Structured Streaming.

The spool is a stream of files; every micro-batch is judged, normalised and
merged into the store as one publish, and the stream's checkpoint remembers what
was taken. Files that are refused are set aside by name, accepted ones are
marked as staged after the publish. A batch that runs again gives the same state
(last record wins, equal records are left out), so delivery is exactly once in
effect. Keys that changed are published with the batch and wait in the store for
the rebuild of the projections, so none is lost between the two.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.operators import catalog as C
from vulnlake.operators import delta as D
from vulnlake.operators import normalize as N
from vulnlake.operators.evidence import keep_last
from vulnlake.plans.store import Store
from vulnlake.session import reliable_checkpoint
from vulnlake.sources.spool import NOT_SPOOL, READY, SNAPSHOT_SOURCE, SpoolFiles, judge_files, last_envelopes

#: Evidence tables and what makes each from normalised records.
EVIDENCE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "source_record_identifiers": N.record_identifiers,
    "source_record_relations": N.record_relations,
    "affected_facts": N.affected_facts,
    "severity_scores": N.severity_scores,
    "evidence_references": N.evidence_references,
    "weaknesses": N.record_weaknesses,
    "threat_scores": N.threat_scores,
}
RECORD_KEY, RAW_KEY = ["source_code", "source_record_id"], ["source_code", "raw_index_id"]
EXPLOITS = (
    "source_code string, raw_index_id string, source_key string, identifiers string, title string, source_url string, artifact_type string, exploit_type string, "
    "maturity string, verification_status string, published_at string, modified_at string, snapshot_id string, is_active boolean"
)
PENDING = "vulnerability_key string"


def spool_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Ready spool files as a stream of lines with their file, oldest file first;
    within a batch, lines go by run and sequence. Files a batch has set aside
    before it failed are not missed when it runs again, and files are taken
    however old they are."""
    stream = spark.readStream.option("pathGlobFilter", f"*{READY}").option("maxFileAge", "36500d").option("maxFilesPerTrigger", files_per_batch).option("ignoreMissingFiles", "true").text(folder)
    lines = stream.select("value", F.col("_metadata.file_path").alias("file"))
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    return lines.where(~name.startswith(NOT_SPOOL) & (F.trim("value") != ""))


def _numbered(batch: DataFrame) -> DataFrame:
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    return batch.withColumns(
        {
            "run": F.regexp_replace(name, r"(-s\d+)?\.ndjson\.ready$", ""),
            "sequence": F.coalesce(F.regexp_extract(name, r"-s(\d+)\.ndjson", 1).try_cast("int"), F.lit(0)),
            "line_no": F.monotonically_increasing_id(),
        }
    )


@dataclass
class Drained:
    """What a drain did: batches, files by outcome, and the kind of rebuild."""

    batches: int = 0
    accepted: list[str] = field(default_factory=list)
    refused: list[str] = field(default_factory=list)
    rebuild: str = "none"


def _after_resets(envelopes: DataFrame) -> tuple[DataFrame, list[str]]:
    """M3: lines that stand after the last reset of their source, and the sources
    reset: initial loads that do not append, and the full list of known exploits."""
    v = F.col("envelope")
    source = F.lower(N.text(v, "$.sourceCode"))
    resets = (source.endswith("-init") & (F.lower(F.coalesce(N.text(v, "$.sourceMode"), F.lit(""))) != "append")) | (source == "cisa-kev")
    logical = envelopes.withColumn("logical", N.canonical_source(source))
    last = logical.where(resets).groupBy("logical").agg(F.max(F.struct("run", "sequence")).alias("reset"))
    found = sorted(r["logical"] for r in last.toLocalIterator())  # sources, of which there are few
    kept = logical.join(F.broadcast(last) if len(found) <= 1000 else last, "logical", "left").where("reset is null or struct(run, sequence) >= reset")
    return kept.drop("logical", "reset"), found


def _buckets(store: Store, keys: DataFrame, columns: list[str]) -> list[int]:
    """Buckets in which keys lie: at most as many as a table has."""
    return sorted(r["b"] for r in keys.select(store.bucket_of(*columns).alias("b")).distinct().toLocalIterator())


def merge_batch(store: Store, batch: DataFrame, spool: SpoolFiles | None = None, done: Drained | None = None) -> DataFrame:
    """One micro-batch into the store, in the buckets it
    touches; gives the changed keys (old and new), which also wait in the store's
    ``pending_keys``. ``spool`` gets the outcome of each file."""
    done = done if done is not None else Drained()
    base = store.number()
    lines = reliable_checkpoint(_numbered(batch))  # line numbers must not change when a task runs again
    judged = reliable_checkpoint(judge_files(lines))
    parsed = N.parse_envelopes(lines).join(judged.where("accepted").select("file", "source"), "file", "left_semi")
    envelopes = reliable_checkpoint(parsed)
    snapshot = F.lower(N.text(F.col("envelope"), "$.sourceCode")) == SNAPSHOT_SOURCE
    live, resets = _after_resets(envelopes.where(~snapshot))
    normalized = reliable_checkpoint(N.normalize_envelopes(last_envelopes(live)).drop("envelope"))

    fresh = N.source_records(normalized)
    schema = fresh.drop("force_normalize").schema
    reset = F.col("source_code").isin(*resets) if resets else F.lit(False)
    everything = bool(resets)
    by_record = None if everything else _buckets(store, normalized, RECORD_KEY)
    by_raw = None if everything else _buckets(store, normalized, RAW_KEY)
    before = store.read("source_records", schema, by_record)
    current = before.where(~reset)
    changed = D.changed_records(current, fresh)
    touched = reliable_checkpoint(changed.select(*RECORD_KEY).distinct())
    kept = normalized.join(touched, RECORD_KEY, "left_semi")
    rows = N.source_records(kept).drop("force_normalize")
    replaced = before.where(reset).select("vulnerability_key").unionByName(before.join(touched, RECORD_KEY, "left_semi").select("vulnerability_key"))
    keys = reliable_checkpoint(D.changed_keys(replaced, rows))

    tables = {"source_records": D.replace_by_keys(current, rows, RECORD_KEY)}
    ways = {"source_records": (RECORD_KEY, by_record)}
    for name, make in EVIDENCE.items():
        part = make(kept)
        by = RAW_KEY if "raw_index_id" in part.columns else RECORD_KEY
        ways[name] = (by, by_raw if by == RAW_KEY else by_record)
        gone = kept.select(*by).distinct()
        tables[name] = store.read(name, part.schema, ways[name][1]).where(~reset).join(gone, by, "left_anti").unionByName(part)

    entries = keep_last(N.record_exploits(normalized), RAW_KEY, ["modified_at"])
    snapshots, bad = _snapshots(envelopes.where(snapshot)), []
    exploits = D.upsert_exploits(store.read("exploits", EXPLOITS, None if snapshots else by_raw).where(~reset), entries)
    for file, found, identity in snapshots:
        try:
            exploits = reliable_checkpoint(D.apply_snapshot(exploits, found, SNAPSHOT_SOURCE, identity))
        except ValueError:
            bad.append(file)
    tables["exploits"], ways["exploits"] = exploits, (RAW_KEY, None if snapshots else by_raw)
    tables["pending_keys"] = D.changed_keys(store.read("pending_keys", PENDING), keys)
    store.publish(tables, base, ways)

    for row in judged.select("file", "accepted").toLocalIterator():  # one row per file of the batch
        name = row["file"].rsplit("/", 1)[1]
        (done.accepted if row["accepted"] and name not in bad else done.refused).append(name)
    if spool is not None:
        spool.finish(judged, bad)
    return keys


def _snapshots(envelopes: DataFrame) -> list[tuple[str, DataFrame, str]]:
    """Full snapshots of the exploit list in a batch, one per file, in order."""
    v = F.col("envelope")
    files = envelopes.groupBy("file", "run", "sequence").agg(F.max(N.text(v, "$.snapshotId")).alias("id")).orderBy("run", "sequence", "file")
    out = []
    for row in files.toLocalIterator():  # one row per snapshot file of the batch
        found = N.record_exploits(N.normalize_envelopes(envelopes.where(F.col("file") == row["file"])))
        out.append((row["file"].rsplit("/", 1)[1], found, row["id"]))
    return out


def rebuild_projections(store: Store, threshold: int = D.FULL_REBUILD) -> str:
    """Owners, components and catalog after the pending keys changed:
    all of them beyond the threshold, else those of the keys. Gives the kind."""
    base = store.number()
    pending = store.read("pending_keys", PENDING)
    kind = D.rebuild_kind(pending, threshold)
    if kind == "none":
        return kind
    keys = reliable_checkpoint(pending)
    records, identifiers, severity, facts = (store.read(n) for n in ("source_records", "source_record_identifiers", "severity_scores", "affected_facts"))
    known = store.manifest()
    if kind == "full" or not {"alias_owners", "affected_components", "vulnerabilities"} <= set(known):
        kind = "full"
        rows = C.record_rollup(records).select(F.col("vulnerability_id").alias("id"), F.col("vulnerability_key").alias("primary_identifier"))
        components = reliable_checkpoint(C.affected_components(facts, rows))
        owners = C.alias_owners(identifiers, records)
        catalog = C.catalog(records, identifiers, severity, components)
    else:
        part = lambda df: df.join(keys, "vulnerability_key", "left_semi")
        rows = C.record_rollup(part(records)).select(F.col("vulnerability_id").alias("id"), F.col("vulnerability_key").alias("primary_identifier"))
        old, previous = store.read("affected_components"), store.read("vulnerabilities")
        gone = keys.select(N.vulnerability_guid(F.col("vulnerability_key")).alias("vulnerability_id"))
        components = reliable_checkpoint(old.join(gone, "vulnerability_id", "left_anti").unionByName(C.affected_components(part(facts), rows)))
        owners = C.rebuild_owners(store.read("alias_owners"), identifiers, records, keys)
        catalog = C.rebuild_catalog(previous, records, identifiers, severity, components, keys)
    tables = {"alias_owners": owners, "affected_components": components, "vulnerabilities": catalog, "pending_keys": store.spark.createDataFrame([], PENDING)}
    store.publish(tables, base)
    return kind


def drain_spool(
    spark: SparkSession, folder: str, store: Store, checkpoint: str, on_keys: Callable[[DataFrame, int], None] | None = None, files_per_batch: int = 100, rebuild: bool = False
) -> Drained:
    """Takes all ready files, then ends; with ``rebuild`` the projections follow.

    Files left in work by a run that died are ready again. ``on_keys`` gets the
    changed keys of each batch.
    """
    done, spool = Drained(), SpoolFiles(spark, folder)
    spool.recover()

    def each(batch: DataFrame, number: int) -> None:
        keys = merge_batch(store, batch, spool, done)
        done.batches += 1
        if on_keys:
            on_keys(keys, number)

    query = spool_stream(spark, folder, files_per_batch).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if rebuild:
        done.rebuild = rebuild_projections(store)
    return done


# Cursors --------------------------------------------------------------------


def after_cursor(index: DataFrame, modified_at: str | None, ids: list[str], stamp: str = "modified_at", key: str = "id") -> DataFrame:
    """Index rows strictly newer than the cursor, or of its time and not yet
    seen; without a cursor the source must be loaded first (ValueError)."""
    if modified_at is None:
        raise ValueError("bootstrap required: there is no cursor")
    newer = F.col(stamp) > modified_at
    return index.where(newer | ((F.col(stamp) == modified_at) & ~F.col(key).isin(*ids)) if ids else newer | (F.col(stamp) == modified_at))


def next_cursor(taken: DataFrame, modified_at: str, ids: list[str], stamp: str = "modified_at", key: str = "id") -> tuple[str, list[str]]:
    """The cursor after rows were taken: the latest time and the ids seen at it
    (an index has few ids of one time)."""
    last = taken.agg(F.max(stamp).alias("m")).first()["m"]
    if last is None:
        return modified_at, ids
    at = sorted(r[key] for r in taken.where(F.col(stamp) == last).select(key).distinct().toLocalIterator())
    return last, sorted({*at, *ids}) if last == modified_at else at


def next_index_batch(
    index: DataFrame, modified_at: str | None, ids: list[str], size: int, pending: dict | None = None, stamp: str = "modified_at", key: str = "id"
) -> tuple[DataFrame, dict | None]:
    """The next ``size`` rows after the cursor, oldest first, and where to go on
    (None after the last).

    ``pending`` is what the call before gave. An index that has changed since
    (told by a digest of its rows after the cursor) is begun anew.
    """
    fresh = after_cursor(index, modified_at, ids, stamp, key).select(*index.columns)
    row = F.xxhash64(F.col(stamp), F.col(key))
    mark = fresh.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x")).first()
    digest = f"{mark['n']}:{mark['x']}"
    offset = pending["offset"] if pending and pending["digest"] == digest else 0
    rows = fresh.orderBy(stamp, key).offset(offset).limit(size)
    return rows, {"digest": digest, "offset": offset + size} if offset + size < mark["n"] else None


def is_reverse_chronological(index: DataFrame, place: str, stamp: str = "modified_at") -> bool:
    """Whether times never grow along the index.

    Checked in blocks of rows and between the blocks' ends, so no task sees all.
    """
    from pyspark.sql import Window

    block = F.floor(F.col(place) / 100_000)
    inner = Window.partitionBy("__b").orderBy(place)
    rows = index.withColumn("__b", block)
    rising = rows.withColumn("__before", F.lag(stamp).over(inner)).where(F.col(stamp) > F.col("__before"))
    ends = rows.groupBy("__b").agg(F.min_by(stamp, place).alias("first"), F.max_by(stamp, place).alias("last"))
    across = ends.withColumn("__before", F.lag("last").over(Window.partitionBy(F.lit(1)).orderBy("__b"))).where(F.col("first") > F.col("__before"))
    return rising.isEmpty() and across.isEmpty()


# Snapshots ------------------------------------------------------------------


def merge_score_batch(store: Store, batch: DataFrame) -> dict[str, int]:
    """One score snapshot into the store; refused feeds leave it as it was."""
    current = store.read("threat_scores_epss", "vulnerability_key string, score double, percentile double, observed_at string")
    state, counts = D.merge_scores(current, batch)
    store.publish({"threat_scores_epss": state})
    return counts


def apply_exploit_snapshot(store: Store, incoming: DataFrame, source: str, snapshot_id: str, expected: int, schema: str) -> None:
    """One exploit snapshot into the store, if it holds as many records as
    its checkpoint says."""
    rows = keep_last(incoming, ["source_code", "raw_index_id"], ["modified_at"])
    if rows.count() != expected:
        raise ValueError("the snapshot disagrees with its checkpoint")
    store.publish({"exploits": D.apply_snapshot(store.read("exploits", schema), rows, source, snapshot_id)})


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", stamp: str = "ts", kind: str | Column = "event_type") -> DataFrame:
    """Counts per window of an event stream, late rows up to a watermark."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, window), kind).agg(F.count("*").alias("n"))
