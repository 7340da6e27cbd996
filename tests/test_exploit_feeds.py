import json
import zipfile

import pytest

from vulnlake.operators import delta, sbom
from vulnlake.sources import exploit_feeds as E
from vulnlake.sources import feeds, registry
from vulnlake.streaming.drain import next_index_batch


def files(spark, *rows):
    return spark.createDataFrame([(p, b if b is None or isinstance(b, str) else json.dumps(b)) for p, b in rows], "path string, body string")


def test_framework_modules(spark):
    body = "Rank = GreatRanking\n'Name' => 'Box Remote Code Execution',\n'Author' => ['Ann', \"Bo\"],\n['CVE', '2031-1111'] CVE-2031-1111"
    rows = E.framework_modules(files(spark, ("modules/exploits/linux/box.rb", body), ("modules/post/x.rb", body), ("modules/exploits/a.rb", "no id"), ("modules/exploits/b.rb", None)), "https://h/").collect()
    assert [(r["source_key"], r["title"], r["exploit_type"], r["author"], r["platform"], r["artifact_type"], r["maturity"], r["identifiers"]) for r in rows] == [
        ("modules/exploits/linux/box.rb", "Box Remote Code Execution", "rce", "Ann, Bo", "linux", "metasploit_module", "metasploit", ["CVE-2031-1111"])]


def test_templates(spark):
    one = {"id": "CVE-2031-2", "info": {"name": "N", "author": ["a", "b"], "metadata": {"verified": True, "product": "p"}, "classification": {"cve-id": "CVE-2031-22222"}}}
    rows = E.template_entries(files(spark, ("t/1.yaml", one), ("t/2.yaml", {"id": "x", "info": {"name": "none"}}), ("t/3.yaml", "{")), "https://h/").collect()
    assert [(r["source_key"], r["identifiers"], r["author"], r["verification_status"], r["maturity"], r["platform"]) for r in rows] == [("CVE-2031-2", ["CVE-2031-22222"], "a, b", "source_verified", "verified-template", "p")]


def test_repositories_and_index_pages(spark):
    repos = [{"full_name": "a/b", "description": "sqli poc", "html_url": "u", "owner": {"login": "a"}, "pushed_at": "2031"}, {"name": "nameless"}]
    got = E.repository_entries(files(spark, ("2031/CVE-2031-4444.json", repos), ("2031/readme.json", repos), ("CVE-2031-5555.json", "{")))
    assert [(r["source_key"], r["title"], r["exploit_type"], r["modified_at"], r["author"]) for r in got.collect()] == [("CVE-2031-4444:a/b", "sqli poc", "sqli", "2031", "a")]
    pages = E.index_pages(files(spark, ("2031/cve-2031-4444.md", "x\n### [CVE-2031-4444](u)\ncrash"), ("notes.md", "### y"))).collect()
    assert [(r["source_key"], r["title"], r["exploit_type"], r["artifact_type"]) for r in pages] == [("CVE-2031-4444", "CVE-2031-4444", "dos", "poc_index")]


def test_csaf_and_audit(spark):
    doc = {"document": {"title": "Fix for CVE-2031-1234", "tracking": {"id": "S-1", "initial_release_date": "d1", "current_release_date": "d2"}}, "vulnerabilities": [{"cve": "CVE-2031-9999"}]}
    rows = E.csaf_envelopes(files(spark, ("a/s-1.json", doc), ("b/s-2.json", {}), ("c.json", "{"))).collect()
    assert {r["external_id"]: (r["identifiers"], r["modified_at"]) for r in rows} == {"S-1": (["S-1", "CVE-2031-9999", "CVE-2031-1234"], "d2"), "s-2": (["s-2"], None)}
    page = {"p": [{"id": 7, "url": "https://h/GHSA-aaaa-bbbb-cccc", "title": "t CVE-2031-1234", "vulnerable_versions": "< 2", "cwe": ["CWE-1"]}, {"id": 8, "title": "u"}], "q": []}
    found = E.audit_records(files(spark, ("", page))).collect()
    assert {r["external_key"]: r["identifiers"] for r in found} == {"p/GHSA-AAAA-BBBB-CCCC": ["GHSA-AAAA-BBBB-CCCC", "CVE-2031-1234"], "p/NPM-8": ["NPM-8"]}
    payload = json.loads(next(r["payload_json"] for r in found if r["external_id"].startswith("GHSA")))
    assert payload["vulnerabilities"][0] == {"package": {"ecosystem": "npm", "name": "p"}, "vulnerable_version_range": "< 2"} and payload["cwes"] == [{"cwe_id": "CWE-1"}]


def test_insert_missing_and_drop_bill(spark):
    current = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    assert sorted(map(str, delta.insert_missing(current, spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (None, "m")], "k int, v string"), ["k"]).collect())) == sorted(["Row(k=1, v='a')", "Row(k=None, v='n')", "Row(k=2, v='c')"])
    bills = spark.createDataFrame([("s1", 1), ("s2", 2), (None, 3)], "sbom_id string, n int")
    left = sbom.without_bill({"bills": bills, "components": bills}, "s1")
    assert {name: sorted(r["n"] for r in df.collect()) for name, df in left.items()} == {"bills": [2, 3], "components": [2, 3]}


def test_quoted_csv(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c\nd', 1, None)], "t string, n int, e string")
    feeds.write_quoted_csv(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == '"t","n","e"\n"a ""b"", c\nd","1",""\n'


def test_archives_are_read_in_stretches(spark, tmp_path):
    for name, n in (("a", 10), ("b", 0)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.mkdir("d")
            for k in range(n):
                z.writestr(f"d/X-{k:02d}.json", f"{{{k}}}")
            z.writestr("note.txt", "no")
    rows = feeds.read_archives(spark, str(tmp_path / "*.zip"), task_entries=3)
    assert sorted((r["place"], r["entry"], r["body"]) for r in rows.collect()) == [(k, f"d/X-{k:02d}.json", f"{{{k}}}") for k in range(10)]
    assert rows.rdd.getNumPartitions() >= 4
    assert sorted(r["place"] for r in feeds.read_archives(spark, str(tmp_path / "a.zip"), start=7, task_entries=4).collect()) == [7, 8, 9]
    assert sorted(r["place"] for r in feeds.read_archives(spark, str(tmp_path / "a.zip"), ids=["X-01", "X-09", "Y"]).collect()) == [1, 9]
    marks = feeds.changed_archives(spark, str(tmp_path / "*.zip"), {})
    assert len(marks) == 2 and feeds.changed_archives(spark, str(tmp_path / "*.zip"), marks) == {}


def test_samples(spark):
    rows = spark.createDataFrame([("a", 1, [1]), ("a", 2, [1, 2]), ("b", 3, []), ("a", 4, [3, 4])], "c string, n int, items array<int>")
    assert sorted((r["category"], r["n_records"], r["n"]) for r in feeds.boundary_samples(rows, rows["c"], ["n"]).collect()) == [("a", 3, 1), ("b", 1, 3)]
    from pyspark.sql import functions as F

    assert sorted((r["category"], r["most"], r["n"]) for r in feeds.largest_samples(rows, rows["c"], F.size("items"), ["n"]).collect()) == [("a", 2, 2), ("b", 0, 3)]


def test_index_batches_resume_and_begin_anew(spark):
    index = spark.createDataFrame([(f"t{n // 2}", f"i{n}") for n in range(9)], "modified_at string, id string")
    take = lambda df, pending: (lambda rows, state: ([r["id"] for r in rows.collect()], state))(*next_index_batch(df, "t1", ["i2"], 3, pending))
    first, state = take(index, None)
    second, last = take(index, state)
    assert (first, second, last) == (["i3", "i4", "i5"], ["i6", "i7", "i8"], None)
    more = index.union(spark.createDataFrame([("t9", "new")], index.schema))
    assert take(more, state)[0] == first
    with pytest.raises(ValueError):
        next_index_batch(index, None, [], 3)


def test_sources_wait_for_their_baseline(spark, tmp_path):
    known = registry.Registry()
    known.add(registry.Source("x", lambda s, state: s.range(3), baseline="x-init"))
    known.add(registry.Source("y", lambda s, state: s.range(1)))
    assert known.run_cycle(spark, {})["x"]["status"] == "waiting" and known.run_cycle(spark, {"x-init": {"status": "ok"}})["x"]["records"] == 3
    for code in ("x", "y", "z"):
        (tmp_path / "mirrors" / code).mkdir(parents=True)
    (tmp_path / "spool").mkdir()
    (tmp_path / "spool" / "y-run-s0001.ndjson.ready").write_text("")
    assert registry.clear_mirrors(spark, str(tmp_path / "mirrors"), str(tmp_path / "spool"), ["x", "y"]) == ["x"]
    assert sorted(p.name for p in (tmp_path / "mirrors").iterdir()) == ["y", "z"]
