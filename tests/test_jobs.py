"""The registered jobs notice an operator that does nothing."""

import __spark_entry__ as entry
from vulnlake.operators import catalog, delta


def test_equal_hashes_decide(spark, sf, monkeypatch):
    taken = sorted(r[0] for r in entry.queries()["p25_changed_records"](spark, sf).collect())
    monkeypatch.setattr(delta, "changed_records", lambda current, incoming: incoming)
    assert taken and taken != sorted(r[0] for r in entry.queries()["p25_changed_records"](spark, sf).collect())


def test_stale_catalog_differs(spark, sf, monkeypatch):
    rows = lambda: {r["primary_identifier"]: r["title"] for r in entry.queries()["m09_keyed_rebuild_catalog"](spark, sf).collect()}
    full = rows()
    monkeypatch.setattr(catalog, "rebuild_catalog", lambda previous, *rest: previous)
    stale = rows()
    assert set(full) - set(stale) and set(stale) - set(full) and any(stale[k] != full[k] for k in set(full) & set(stale))
