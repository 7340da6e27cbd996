import random

from vulnlake.operators.snapshots import FAN, LEAF_KEYS, diff_snapshots, differing_leaves, complete_order, leaf_digests, snapshot_states, tree_levels, with_leaf

COLUMNS = ["title", "url"]
ENTRY = "exploit_row long, source_code string, source_key string, title string, url string, snapshot_id string, is_active boolean, change_kind string"
DELIVERY = "source_code string, snapshot_id string, delivered_at long, is_complete boolean"


def entries(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], ENTRY)


def run(spark, rows, deliveries):
    found = diff_snapshots(entries(spark, rows), spark.createDataFrame(deliveries, DELIVERY), "source_key", "exploit_row", "is_active", COLUMNS)
    return sorted(tuple(r) for r in found.collect())


DELIVERIES = [("f", "s1", 1, True), ("f", "bad", 2, False), ("f", "s2", 3, True), ("f", "s3", 4, True), ("g", "s1", 1, True), ("g", "s2", 2, True)]


def test_diff(spark):
    rows = [
        (1, "f", "same", "t", None, "s1", None), (2, "f", "same", " t ", " ", "s2", True), (3, "f", "same", "t", "", "s3", True),
        (4, "f", "gone", "t", "u", "s1", True), (5, "f", "off", "t", "u", "s1", True), (6, "f", "off", "t", "u", "s2", False),
        (7, "f", "new", "t", "u", "s2", True), (8, "f", "new", "t2", "u", "s3", True), (9, "f", "half", "t", "u", "bad", True),
        (10, "f", "twice", "a", "u", "s1", True), (11, "f", "twice", "b", "u", "s1", True), (12, "f", "twice", "b", "u", "s2", True), (13, "f", "twice", "b", "u", "s3", True),
        (14, "f", None, "t", "u", "s1", True), (15, "f", "loose", "t", "u", None, True), (16, "g", "x", "t", "u", "s1", True), (17, None, "y", "t", "u", "s2", True),
    ]
    assert run(spark, rows, DELIVERIES) == [
        ("f", "gone", "s2", "removed"), ("f", "new", "s2", "added"), ("f", "new", "s3", "changed"), ("f", "off", "s2", "removed"), ("g", "x", "s2", "removed"),
    ]


def test_empty(spark):
    assert run(spark, [], DELIVERIES) == []
    assert run(spark, [(1, "f", "a", "t", "u", "s1", True)], []) == []


def test_equal_leaves_are_not_compared(spark):
    rows = [(n, "f", f"k{n % 500}", "t", "u", "s1" if n < 500 else "s2", True) for n in range(1000)]
    rows[700] = (*rows[700][:3], "other", *rows[700][4:])
    order = complete_order(spark.createDataFrame(DELIVERIES[:1] + DELIVERIES[2:3], DELIVERY))
    states = with_leaf(snapshot_states(entries(spark, rows), order, "source_key", "exploit_row", "is_active", COLUMNS), 2)
    assert differing_leaves(leaf_digests(states), order, 2).count() == 1
    assert run(spark, rows, DELIVERIES[:1] + DELIVERIES[2:3]) == [("f", "k200", "s2", "changed")]


def test_rows_of_equal_leaves_are_dropped(spark):
    """Of 3000 keys one changed: the tree leaves only the rows of its leaf to compare."""
    rows = [(n, "f", f"k{n % 3000}", "t", "u", "s1" if n < 3000 else "s2", True) for n in range(6000)]
    rows[4000] = (*rows[4000][:3], "other", *rows[4000][4:])
    order = complete_order(spark.createDataFrame([("f", "s1", 1, True), ("f", "s2", 2, True)], DELIVERY))
    states = with_leaf(snapshot_states(entries(spark, rows), order, "source_key", "exploit_row", "is_active", COLUMNS), 2)
    leaves = differing_leaves(leaf_digests(states), order, 2)
    assert 2 <= states.join(leaves.select("source_code", "leaf"), ["source_code", "leaf"], "left_semi").count() <= 20


def test_the_tree_grows_with_the_keys():
    assert tree_levels(10, 2) == 2 and tree_levels(FAN**2 * LEAF_KEYS * 2 + 2, 2) == 3 and tree_levels(0, 0) == 2 and tree_levels(1 << 60, 1) == 5


def test_many_snapshots_equal_brute_force(spark):
    """Random feeds, places without entries, entries that go and return, rows in any order."""
    rng = random.Random(3)
    deliveries = [(f, f"s{n}", n, rng.random() < 0.8) for f in "fgh" for n in range(7)]
    rows = []
    for n in range(1, 2500):
        rows.append((n, rng.choice("fggx"), f"k{rng.randrange(60)}", rng.choice("ab"), rng.choice([None, " u"]), f"s{rng.randrange(6)}", rng.choice([True, True, None, False])))
    rng.shuffle(rows)
    want = []
    for feed in "fgh":
        before = None
        for _, snapshot, _, complete in sorted((d for d in deliveries if d[0] == feed), key=lambda d: d[2]):
            if not complete:
                continue
            now = {}
            for r in sorted(r for r in rows if r[1] == feed and r[5] == snapshot):
                now[r[2]] = None if r[6] is False else (r[3], (r[4] or "").strip())
            now = {k: v for k, v in now.items() if v}
            if before is not None:
                want += [(feed, k, snapshot, "added") for k in now.keys() - before] + [(feed, k, snapshot, "removed") for k in before.keys() - now] + [(feed, k, snapshot, "changed") for k in now.keys() & before if now[k] != before[k]]
            before = now
    assert run(spark, rows, deliveries) == sorted(want)
