import json

from vulnlake.operators.nested import CHILD_MEMBERS, child_values, flatten, parse, relations_of, schema_graph

SCHEMA = "evidence_no long, evidence_json string, relation string"


def run(spark, *texts):
    df = spark.createDataFrame([(n, t if t is None or isinstance(t, str) else json.dumps(t), "x") for n, t in enumerate(texts, 1)], SCHEMA)
    rows, relations = flatten(df, "evidence_no", "evidence_json")
    return sorted(tuple(r) for r in child_values(rows, relations, "evidence_no").collect())


def test_forms_of_groups(spark):
    one = {"affectedFacts": {"versionRange": "< 1", "severityScores": {"items": [{"vectorString": None}, {"vectorString": "V2"}]}}, "SeverityScores": [{"Vector_String": "R"}]}
    two = {"Record": {"Evidence": {"affected_facts": {"nodes": [{"operator": "OR", "facts": [{"version_range": "a"}, {}], "nodes": [{"facts": [{"version_range": "b"}]}]}, {"facts": {"version_range": "c"}}]}}}}
    three = {"references": ["u", {"url": "v", "tags": ["T", None, " ", {"name": "S"}]}, {"tags": "solo"}], "extra": {"deep": {"x": 1}}}
    assert run(spark, one, two, three) == [
        (1, "fact", 0, 1, "< 1"), (1, "severity", 0, 1, "R"), (1, "severity", 1, 2, "V2"),
        (2, "fact", 0, 1, "a"), (2, "fact", 0, 3, "b"), (2, "fact", 0, 4, "c"),
        (3, "tag", 2, 1, "T"), (3, "tag", 2, 4, "S"), (3, "tag", 3, 1, "solo"),
    ]


def test_unreadable_and_wrapped_texts(spark):
    good = json.dumps({"affectedFacts": [{"versionRange": "x"}]})
    assert run(spark, None, "", "  ", good[:-5], '{"a": ', "null", "[]", "3", json.dumps(good), "﻿" + good, good + "\n") == [(n, "fact", 0, 1, "x") for n in (9, 10, 11)]


def test_deep_and_long_texts(spark):
    deep = "[" * 200_000 + "]" * 200_000
    nodes = {"facts": [{"versionRange": "leaf"}]}
    for _ in range(200):
        nodes = {"nodes": [nodes]}
    wide = {"references": [{"url": "u", "tags": ["t"] * 20_000}]}
    assert parse(deep) is None or parse(deep)
    got = run(spark, {"affectedFacts": nodes}, wide)
    assert got[0] == (1, "fact", 0, 1, "leaf") and len(got) == 20_001


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    rows, relations = flatten(df, "evidence_no", "evidence_json")
    assert rows.count() == 0 and not relations.tables and child_values(rows, relations, "evidence_no").count() == 0


def test_singletons_are_inlined_and_found(spark):
    """Without lists and repetition the graph inlines the groups; the values come out all the same."""
    alone = {"affectedFacts": {"versionRange": "< 1", "severityScores": {"vectorString": "V"}}, "references": {"url": "u", "tags": {"name": "T"}}}
    plain = {"affectedFacts": "just text", "references": {"tags": "S"}}
    df = spark.createDataFrame([(1, json.dumps(alone), "x"), (2, json.dumps(plain), "x")], SCHEMA)
    rows, relations = flatten(df, "evidence_no", "evidence_json", CHILD_MEMBERS)
    assert not relations.tables and {r["relation"] for r in rows.collect()} == {"record_root"}
    expected = [(1, "fact", 0, 1, "< 1"), (1, "severity", 1, 1, "V"), (1, "tag", 1, 1, "T"), (2, "fact", 0, 1, "just text"), (2, "tag", 1, 1, "S")]
    assert run(spark, alone, plain) == expected
    # a record with lists changes the graph, and with it the tables of all records
    lists = {"affectedFacts": [{"severityScores": [{"vectorString": "W"}]}], "severityScores": [], "references": [{"tags": ["R"]}]}
    assert run(spark, alone, plain, lists) == [*expected, (3, "severity", 1, 1, "W"), (3, "tag", 1, 1, "R")]


def test_another_graph_gives_other_tables(spark, sf):
    from vulnlake.operators.nested import Relations, shred_texts
    from vulnlake.session import table

    df = table(spark, sf, "evidence_records")
    rows, relations = flatten(df, "evidence_no", "evidence_json")
    count = lambda found: {r["relation"]: r["n"] for r in found.groupBy("relation").count().withColumnRenamed("count", "n").collect()}
    assert set(count(rows)) == relations.tables | {"record_root"}
    none = Relations(frozenset(), frozenset(), frozenset())
    assert set(count(shred_texts(df, "evidence_no", "evidence_json", none))) == {"record_root"}
    fewer = Relations(relations.tables - {"tags"}, relations.shared, relations.recursive)
    assert set(count(shred_texts(df, "evidence_no", "evidence_json", fewer))) == set(count(rows)) - {"tags"}


def test_a_value_spelled_twice_is_kept(spark):
    twice = {"affectedFacts": [{"versionRange": " ", "version_range": "< 2"}, {"VersionRange": "< 3"}, {"versionRange": None}], "references": [{"tags": [{"name": "a", "Name": "b"}]}]}
    df = spark.createDataFrame([(1, json.dumps(twice), "x")], SCHEMA)
    rows, relations = flatten(df, "evidence_no", "evidence_json", CHILD_MEMBERS)
    assert {"versionrange", "name"} <= relations.tables
    assert sorted(tuple(r) for r in child_values(rows, relations, "evidence_no").collect()) == [(1, "fact", 0, 1, "< 2"), (1, "fact", 0, 2, "< 3"), (1, "tag", 1, 1, "a")]
    assert sorted(r["members"]["value"] or "" for r in rows.where("relation = 'versionrange'").collect()) == ["", " ", "< 2", "< 3"]
    single = {"affectedFacts": {"versionRange": "x", "version_range": "y"}}
    assert run(spark, single) == [(1, "fact", 0, 1, "x")]


def test_pruning_changes_nothing(spark, sf):
    from vulnlake.session import table

    df = table(spark, sf, "evidence_records")
    whole, relations = flatten(df, "evidence_no", "evidence_json")
    pruned, _ = flatten(df, "evidence_no", "evidence_json", CHILD_MEMBERS)
    assert sorted(map(tuple, child_values(whole, relations, "n").collect())) == sorted(map(tuple, child_values(pruned, relations, "n").collect()))


def test_schema_graph_and_inlining(spark):
    df = spark.createDataFrame([(1, json.dumps({"one": {"two": 2}, "many": [{"a": 1}, {"a": 2}], "self": [{"self": [{"v": 1}]}], "p": {"shared": {"x": 1}}, "q": {"shared": {"x": 2}}}), "x")], SCHEMA)
    edges = [tuple(r) for r in schema_graph(df, "evidence_json").collect()]
    found = relations_of(edges)
    assert {"many", "self", "shared"} <= found.tables and "one" not in found.tables
    assert "self" in found.recursive and "shared" in found.shared
    rows, _ = flatten(df, "evidence_no", "evidence_json")
    root = rows.where("relation = 'record_root'").first()["members"]
    assert root["one.two"] == "2"


def test_links_lead_to_parents(spark, sf):
    from vulnlake.session import table

    rows, _ = flatten(table(spark, sf, "evidence_records"), "evidence_no", "evidence_json")
    keys = rows.selectExpr("doc", "relation as parent_relation", "row_id as parent_id")
    assert rows.where("parent_id is not null").join(keys, ["doc", "parent_relation", "parent_id"], "left_anti").count() == 0
