import pytest

from vulnlake.operators.evidence import affected_keys, projection_state
from vulnlake.plans.search import equals_or_in, key_list, rows_of_keys
from vulnlake.plans.store import Store, with_columns_of
from vulnlake.sources.registry import agreed_records, resume_offset, with_progress


def test_key_lists(spark):
    df = spark.createDataFrame([("A-1",), (" a-2 ",), ("B-1",), (None,)], "k string")
    assert key_list([" a-1", "A-1", None, "", "b-2"]) == ["A-1", "B-2"]
    assert df.where(equals_or_in("k", [None])).count() == 0 and df.where(equals_or_in("k", ["A-1"])).count() == 1 and df.where(equals_or_in("k", ["A-1", "B-1", None])).count() == 2
    assert sorted(r["k"] for r in rows_of_keys(df, "k", spark.createDataFrame([("a-1 ",), ("A-2",), ("",), (None,), ("A-1",)], "x string")).collect()) == [" a-2 ", "A-1"]


def test_projection_state(spark):
    records = spark.createDataFrame([("osv", "K1"), ("OSV", "K1"), ("nvd", "K2")], "source_code string, vulnerability_key string")
    facts = spark.createDataFrame([("nvd", "K2", "r1"), ("nvd", "K3", "r2")], "source_code string, vulnerability_key string, raw_index_id string")
    keys, has = projection_state(records, facts, "osv")
    assert [r[0] for r in keys.collect()] == ["K1"] and not has and projection_state(records, facts, "NVD")[1]
    assert affected_keys(facts).count() == 2 and [r[0] for r in affected_keys(facts, spark.createDataFrame([("r2",), ("r9",)], "raw_index_id string")).collect()] == ["K3"]


def test_bulk_replace(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.publish({"t": spark.range(3)})
    with pytest.raises(RuntimeError), store.replacing("t") as session:
        session.append(spark.range(5))
        raise RuntimeError
    assert store.read("t").count() == 3 and len(list((tmp_path / "t").glob("v=*"))) == 1
    with store.replacing("t") as session:
        session.append(spark.range(5))
        session.append(spark.range(2))
        with pytest.raises(ValueError):
            session.append(spark.range(1).selectExpr("cast(id as string) AS id"))
    assert store.read("t").count() == 7
    with store.replacing("t"):
        pass
    assert store.read("t").count() == 7


def test_older_schemas(spark):
    old = spark.createDataFrame([(1, "x")], "a int, gone string")
    assert [r.asDict() for r in with_columns_of(old, "a bigint, b string").collect()] == [{"a": 1, "b": None}]


def test_checkpoints():
    saved = with_progress({"hasRecords": True}, {"etag": "e1"}, 40)
    assert resume_offset(saved, {"etag": "e1"}) == 40 and resume_offset(saved, {"etag": "e2"}) == 0 and resume_offset(None, {"etag": "e1"}) == 0
    good = {"gitRevision": "r", "completedGitRevision": "r", "snapshotComplete": True, "recordCount": 3}
    assert agreed_records(good, "r") == 3
    for bad in ({"recordCount": 0}, {"snapshotComplete": False}, {"completedGitRevision": "q"}, {"recordCount": True}):
        with pytest.raises(ValueError):
            agreed_records(good | bad, "r")
