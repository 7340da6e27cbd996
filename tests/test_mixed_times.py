import itertools
import random
from datetime import datetime, timezone

import numpy as np
import pytest

from vulnlake.functions.timestamps import readings, single_reading
from vulnlake.operators import mixed_times as M


def utc(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2024-01-02T03:04:05Z", "MDY", "Asia/Tokyo", utc(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02", "MDY", "Asia/Tokyo", utc(2024, 1, 1, 15)),
    ("2024-01-02 03:04:05.123456789+02", None, None, utc(2024, 1, 2, 1, 4, 5) + 123456),
    ("02/03/2024 04:05", "DMY", "UTC", utc(2024, 3, 2, 4, 5)),
    ("02/03/2024 04:05", "MDY", "UTC", utc(2024, 2, 3, 4, 5)),
    ("20/03/2024", "MDY", "UTC", None),
    ("20240305", "MDY", "UTC", utc(2024, 3, 5)), ("19990305", "MDY", "UTC", None),
    ("1547902301", "MDY", "Asia/Tokyo", 1547902301 * 10**6), ("1547902301123", "MDY", None, 1547902301123 * 1000),
    ("1547902301123456", "MDY", None, 1547902301123456), ("1547902301123456789", "MDY", None, 1547902301123456),
    ("20240305T010203Z", "MDY", "Asia/Tokyo", utc(2024, 3, 5, 1, 2, 3)), ("20240305010203", None, "UTC", utc(2024, 3, 5, 1, 2, 3)),
    ("Tue, 5 Mar 2024 01:02:03 GMT", None, None, utc(2024, 3, 5, 1, 2, 3)), ("Tue Mar  5 01:02:03 EST 2024", "MDY", "America/New_York", utc(2024, 3, 5, 6, 2, 3)),
    ("5 March 2024", None, "UTC", utc(2024, 3, 5)), ("Mar 5, 2024 12:30 AM", None, "UTC", utc(2024, 3, 5, 0, 30)), ("March 5, 2024, 13:30", None, "UTC", utc(2024, 3, 5, 13, 30)),
    ("2024年3月5日 01:02", None, "Asia/Shanghai", utc(2024, 3, 4, 17, 2)), ("2024-03-05 01:02:03 CST", "YMD", "Asia/Shanghai", utc(2024, 3, 4, 17, 2, 3)),
    ("2024-03-05 01:02:03 CST", "MDY", "America/Chicago", utc(2024, 3, 5, 7, 2, 3)), ("2024-03-05 00:00:00 JST", None, "UTC", utc(2024, 3, 4, 15)),
    ("2024-11-03T01:30:00", "MDY", "America/New_York", utc(2024, 11, 3, 5, 30)),  # twice: the earlier
    ("2024-03-10T02:30:00", "MDY", "America/New_York", utc(2024, 3, 10, 7, 30)),  # skipped: offset before
    ("2024-03-05T01:02:03-05:00[Europe/Berlin]", None, None, utc(2024, 3, 5, 6, 2, 3)), ("2024-03-05T01:02:03[Europe/Berlin]", None, None, utc(2024, 3, 5, 0, 2, 3)),
    ("2024-02-30", None, None, None), ("0000-00-00", None, None, None), ("2023-13-05T10:00:00Z", None, None, None), ("pending", None, None, None),
    ("", None, None, None), (None, None, None, None), ("x" * 100_000, None, None, None), ("9" * 500, None, None, None), ("12:30", None, None, None),
]


@pytest.mark.parametrize("text,order,zone,micros", CASES)
def test_single_reading(text, order, zone, micros):
    assert single_reading(text, order, zone) == micros


def test_ambiguous_without_rules():
    assert {m for _, m in readings("02/03/2024", None, None)} == {utc(2024, 3, 2), utc(2024, 2, 3)}


def _brute(chain):
    best = None
    for path in itertools.product(*chain):
        cost = sum(M.SWITCH * (a[0] != b[0]) + M.BACKWARD * (b[1] < a[1]) for a, b in zip(path, path[1:]))
        best = cost if best is None else min(best, cost)
    return best


def test_viterbi_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rng = random.Random(7)
    rows, chains = [], {}
    for chain in range(8):
        chains[f"s{chain}"] = []
        for n in range(13):
            found = [(rng.randrange(3), rng.randrange(6)) for _ in range(rng.choice([1, 1, 2, 3]))]
            found = list(dict.fromkeys(found))
            chains[f"s{chain}"].append(found)
            rows.append(("f", f"s{chain}", n, *found[0], [{"kind": k, "micros": m} for k, m in found[1:]] or None))
    df = spark.createDataFrame(rows, "field_name string, source_code string, row_no long, kind int, micros long, more array<struct<kind:int,micros:long>>")
    chosen = M.choose_readings(df).collect()
    assert len(chosen) == len(rows)
    for source, chain in chains.items():
        path = [(r["reading_kind"], r["utc_micros"]) for r in sorted((r for r in chosen if r["source_code"] == source), key=lambda r: r["row_no"])]
        assert all(p in found for p, found in zip(path, chain))
        assert _brute([[p] for p in path]) == pytest.approx(_brute(chain))


def test_viterbi_settles_order_from_neighbours(spark):
    rows = [(1, "a", "28/01/2024"), (2, "a", "02/02/2024"), (3, "a", "05/02/2024"), (4, "a", "13/02/2024"), (5, None, "01/02/2024"), (6, "a", None), (7, "a", "x")]
    df = spark.createDataFrame(rows, "row_no long, source_code string, at string").selectExpr("row_no", "source_code", "at", "'x' as utc_micros")
    got = {r["row_no"]: r["utc_micros"] for r in M.normalise_times(df, "row_no", "source_code", ["at"], None, "t").collect()}
    assert got[2] == utc(2024, 2, 2) and got[3] == utc(2024, 2, 5) and set(got) == {1, 2, 3, 4, 5}
    assert M.normalise_times(df.limit(0), "row_no", "source_code", ["at"], None, "t").count() == 0


def test_whole_tables_equal_single_readings(spark, sf):
    from vulnlake.queries.problems import p2_found
    from vulnlake.session import table

    rules = {r["source_code"]: (r["date_order"], r["home_zone"]) for r in table(spark, sf, "source_registry").collect()}
    want = set()
    for name, row, fields in (("source_records", "record_no", ["published_at", "modified_at"]), ("exploits", "exploit_row", ["published_at"])):
        for r in table(spark, sf, name).collect():
            for f in fields:
                micros = single_reading(r[f], *rules[r["source_code"]])
                if micros is not None:
                    want.add((name, r[row], f, micros))
    assert {tuple(r) for r in p2_found(spark, sf).collect()} == want


def test_without_registry_the_path_decides(spark, sf, monkeypatch):
    """Over the whole table: every instant is a reading of its value, the paths cost what
    the best paths cost, and readings that are not the first are chosen."""
    from vulnlake.queries.problems import p2_unregistered
    from vulnlake.session import table

    monkeypatch.setattr(M, "BLOCK", 50)
    got = {(r["field_name"], r["row_no"]): r["utc_micros"] for r in p2_unregistered(spark, sf).collect()}
    chains, seen, later = {}, 0, 0
    for r in sorted(table(spark, sf, "source_records").collect(), key=lambda r: r["record_no"]):
        for f in ("published_at", "modified_at"):
            if found := readings(r[f], None, None):
                chains.setdefault((f, r["source_code"]), []).append((found, got[f, r["record_no"]]))
                seen += 1
    assert seen == len(got)
    for chain in chains.values():
        best, mine = {s: 0.0 for s in chain[0][0]}, 0.0
        path = [next(s for s in found if s[1] == micros) for found, micros in chain]
        later += sum(p != found[0] for p, (found, _) in zip(path, chain))
        cost = lambda a, b: M.SWITCH * (a[0] != b[0]) + M.BACKWARD * (b[1] < a[1])
        for found, _ in chain[1:]:
            best = {s: min(c + cost(b, s) for b, c in best.items()) for s in found}
        mine = sum(cost(a, b) for a, b in zip(path, path[1:]))
        assert mine == pytest.approx(min(best.values()))
    assert later


def test_step_costs():
    assert np.array_equal(M._step([(0, 5)], [(0, 4), (1, 6)]), [[M.BACKWARD, M.SWITCH]])
