"""What changed between full snapshots: Merkle digests first, rows second.

Keys of a feed are hashed into ranges, the leaves of a tree with fan-out
``FAN``; the tree is as deep as ``LEAF_KEYS`` keys a leaf ask for. Rows are
shuffled once, by feed and spot of the key, to the state of each entry in each snapshot,
which is written once: a key and a digest. From there each snapshot gets a
digest per leaf (summed before the shuffle), and digests of digests above. Trees
of consecutive snapshots are compared top-down, each level only below nodes that
differ, and states are compared only in leaves that differ: those of equal
leaves are dropped by the join that names the differing ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnlake.session import blank_to_null, reliable_checkpoint

#: Fan-out of the tree, and keys a leaf should hold on average.
FAN, LEAF_KEYS = 64, 4
#: Levels below the root.
LEVELS = range(2, 6)


def tree_levels(states: int, snapshots: int) -> int:
    """Levels of a tree for the keys of an average snapshot."""
    keys = states / max(1, snapshots)
    return next((n for n in LEVELS if FAN**n * LEAF_KEYS >= keys), LEVELS[-1])


def with_leaf(states: DataFrame, levels: int) -> DataFrame:
    """States with the leaf of a tree of so many levels: their spot, coarser."""
    return states.withColumn("leaf", F.floor(F.col("spot") / FAN ** (LEVELS[-1] - levels)).cast("int"))


def complete_order(snapshots: DataFrame) -> DataFrame:
    """``source_code, snapshot_id, place``: complete snapshots in order of delivery.

    A pair listed twice counts once, as first delivered. The table holds a row
    per delivery, not per entry.
    """
    pairs = snapshots.where(F.col("is_complete") & F.col("snapshot_id").isNotNull() & F.col("source_code").isNotNull())
    pairs = pairs.groupBy("source_code", "snapshot_id").agg(F.min("delivered_at").alias("at"))
    by_feed = Window.partitionBy("source_code").orderBy("at", "snapshot_id")
    return pairs.select(
        "source_code",
        "snapshot_id",
        F.row_number().over(by_feed).cast("bigint").alias("place"),
    )


def snapshot_states(entries: DataFrame, order: DataFrame, key: str, row: str, active: str, compared: list[str]) -> DataFrame:
    """Present entries: ``source_code, spot, place, entry_key, digest``. A spot is a leaf
    of the deepest tree.

    Of several rows of an entry in a snapshot the one with the highest ``row``
    counts; it is present unless ``active`` is false. The digest covers the
    compared columns, where null equals blank and outer white space is ignored.
    """
    content = F.md5(F.to_json(F.array(*(F.coalesce(blank_to_null(F.col(c)), F.lit("")) for c in compared))))
    rows = entries.where(F.col(key).isNotNull() & F.col("snapshot_id").isNotNull()).select(
        "source_code",
        "snapshot_id",
        F.col(key).alias("entry_key"),
        F.struct(F.col(row).alias("row"), F.coalesce(F.col(active), F.lit(True)).alias("on"), content.alias("digest")).alias("v"),
    )
    spot = F.pmod(F.xxhash64("source_code", "entry_key"), F.lit(FAN ** LEVELS[-1])).cast("int")
    placed = rows.join(order.select("source_code", "snapshot_id", "place"), ["source_code", "snapshot_id"]).withColumn("spot", spot)
    last = placed.repartition("source_code", "spot").groupBy("source_code", "spot", "place", "entry_key").agg(F.max("v").alias("v"))
    return last.where("v.on").select("source_code", "spot", "place", "entry_key", F.col("v.digest").alias("digest"))


def leaf_digests(states: DataFrame) -> DataFrame:
    """``source_code, place, node, digest``: order-free digests per leaf."""
    one = F.xxhash64("entry_key", "digest")
    two = F.xxhash64("digest", "entry_key", F.lit(1))
    found = states.groupBy("source_code", "leaf", "place").agg(
        F.md5(F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(one).cast("string"), F.bit_xor(two).cast("string"))).alias("digest")
    )
    return found.select("source_code", "place", F.col("leaf").alias("node"), "digest")


def _above(nodes: DataFrame) -> DataFrame:
    """Digests of the parents of ``nodes``; at most FAN children each."""
    return nodes.groupBy("source_code", "place", F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws("=", c["node"], c["digest"])), ";")).alias("digest")
    )


def _differing(level: DataFrame, order: DataFrame, parents: DataFrame | None) -> DataFrame:
    """``source_code, place, node`` of nodes whose digest differs between the
    snapshot at ``place`` and the one before; only below differing parents."""
    sides = F.array(F.struct(F.col("place"), F.col("digest").alias("now"), F.lit(None).cast("string").alias("then")), F.struct((F.col("place") + 1).alias("place"), F.lit(None).cast("string").alias("now"), F.col("digest").alias("then")))
    pair = level.select("source_code", "node", F.explode(sides).alias("s")).select("source_code", "node", "s.*").where("place > 1")
    if parents is not None:
        above = parents.select("source_code", "place", F.col("node").alias("up"))
        pair = pair.withColumn("up", F.floor(F.col("node") / FAN).cast("int")).join(above, ["source_code", "place", "up"], "left_semi")
    else:
        pair = pair.join(order.select("source_code", "place"), ["source_code", "place"], "left_semi")
    both = pair.groupBy("source_code", "place", "node").agg(F.max("now").alias("now"), F.max("then").alias("then"))
    return both.where(~F.col("now").eqNullSafe(F.col("then"))).select("source_code", "place", "node")


def differing_leaves(leaves: DataFrame, order: DataFrame, levels: int) -> DataFrame:
    """``source_code, place, leaf``: leaves to compare, found from the root down."""
    tree = [leaves]
    for _ in range(levels):
        tree.append(_above(tree[-1]))
    found = None
    for level in reversed(tree):
        found = _differing(level, order, found)
    return found.withColumnRenamed("node", "leaf")


def diff_snapshots(
    entries: DataFrame, snapshots: DataFrame, key: str, row: str, active: str, compared: list[str]
) -> DataFrame:
    """``source_code, entry_key, snapshot_id, change_kind`` for every complete
    snapshot but a feed's first, against the complete one before.

    Entries with a null key, feed or snapshot id, and rows of incomplete or
    unlisted snapshots, do not take part. A complete snapshot without rows
    removes everything. Empty tables give an empty result.
    """
    order = reliable_checkpoint(complete_order(snapshots))
    states = reliable_checkpoint(snapshot_states(entries, order, key, row, active, compared))
    levels = tree_levels(states.count(), order.count())
    states = with_leaf(states, levels)
    leaves = differing_leaves(reliable_checkpoint(leaf_digests(states)), order, levels)
    # A leaf lists the places at which it differs, so a state meets it once, by feed and leaf.
    listed = leaves.groupBy("source_code", "leaf").agg(F.collect_set("place").alias("places"))
    none = F.lit(None).cast("string")
    sides = F.filter(
        F.array(F.struct(F.col("place"), F.col("digest").alias("now"), none.alias("then")), F.struct((F.col("place") + 1).alias("place"), none.alias("now"), F.col("digest").alias("then"))),
        lambda side: F.array_contains("places", side["place"]),
    )
    pairs = states.join(listed, ["source_code", "leaf"]).select("source_code", "leaf", "entry_key", F.explode(sides).alias("s"))
    both = pairs.groupBy("source_code", "leaf", "s.place", "entry_key").agg(F.max("s.now").alias("now"), F.max("s.then").alias("then"))
    kind = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    named = both.withColumn("change_kind", kind).where("change_kind is not null")
    return named.join(order.select("source_code", "place", "snapshot_id"), ["source_code", "place"]).select(
        "source_code", "entry_key", "snapshot_id", "change_kind"
    )
