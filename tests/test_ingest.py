import gzip
import hashlib
import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from vulnlake.operators import delta as D
from vulnlake.operators import normalize as N
from vulnlake.operators.evidence import keep_last
from vulnlake.plans.search import like_pattern, page_bounds, plan_search
from vulnlake.plans.store import Conflict, Store
from vulnlake.sources import feeds, registry
from vulnlake.sources.spool import FAILED, PROCESSING, STAGED, SpoolFiles, judge_files, scan_spool, write_spool
from vulnlake.streaming import drain as S


def line(source, key, payload, **more):
    return json.dumps({"schemaVersion": 1, "sourceCode": source, "externalKey": key, "externalId": key, "recordHash": "h", "identifiers": [], "payload": payload} | more)


def normalized(spark, *lines):
    return N.normalize_envelopes(N.parse_envelopes(spark.createDataFrame([(x,) for x in lines], "value string")))


AFFECTED = [{"package": {"ecosystem": "npm", "name": "p"}, "versions": ["1"]}]


def osv(identifier, **payload):
    return line("osv", identifier, {"id": identifier} | payload)


def test_identity_of_distribution_projections(spark):
    rows = normalized(
        spark,
        osv("MINI-2026-0001", upstream=["CVE-2026-42001", "GHSA-AAAA-BBBB-0001"], affected=AFFECTED), osv("CGA-2026-0002", related=["CGA-2026-0002", "CVE-2026-42002", "GHSA-AAAA-BBBB-0002"]),
        osv("MINI-2026-0003", upstream=["GHSA-AAAA-BBBB-0003"]), osv("MINI-2026-0004", aliases=["CVE-2026-42004"], upstream=["CVE-2026-99999"]), osv("MINI-2026-0005", aliases=["CVE-2026-1111", "CVE-2026-2222"]),
        osv("CGA-2026-0006", aliases=["GHSA-AAAA-BBBB-0006"]), osv("CGA-2026-0008"), osv("ECHO-2026-0009", upstream=["CVE-2026-42009"], references=[{"url": "https://r"}]),
        osv("ECHO-2026-0010", references=[{"url": "https://r"}]), osv("ECHO-2026-0011", upstream=["CVE-2026-42011"], summary="text"), osv("MINI-2026-0012", upstream=["CVE-2026-42012"], references=[{"url": "https://r"}]),
    )
    got = {r["source_record_id"]: (r["vulnerability_key"], r["normalizer_version"], r["upstream"], r["related"]) for r in rows.collect()}
    assert got["MINI-2026-0001"][::2] == ("CVE-2026-42001", ["GHSA-AAAA-BBBB-0001"])
    assert got["CGA-2026-0002"][0] == "CVE-2026-42002" and got["CGA-2026-0002"][3] == ["GHSA-AAAA-BBBB-0002"]
    assert all(got[k][1] == N.UNLINKED for k in ("MINI-2026-0003", "MINI-2026-0005", "CGA-2026-0006", "CGA-2026-0008", "ECHO-2026-0010"))
    assert got["MINI-2026-0004"][::2] == ("CVE-2026-42004", ["CVE-2026-99999"]) and got["ECHO-2026-0009"][0] == "CVE-2026-42009"
    assert got["ECHO-2026-0011"][0] == "ECHO-2026-0011" and got["MINI-2026-0012"][0] == "MINI-2026-0012"


def test_families(spark):
    nvd = {"cve": {"id": "CVE-2024-1000", "descriptions": [{"lang": "fr", "value": "non"}, {"lang": "EN", "value": "Bad"}], "metrics": {"m": [{"cvssData": {"version": "3.1", "baseScore": 7.5}, "baseSeverity": "HIGH"}]},
                   "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:v:p:*", "versionStartIncluding": "1", "versionEndExcluding": "2"}], "nodes": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:v:q:*", "vulnerable": False}]}]}]}]}],
                   "weaknesses": [{"description": [{"value": "CWE-79"}]}]}}
    events = {"package": {"ecosystem": "npm", "name": "a b"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2"}, {"introduced": "2"}, {"last_affected": "2.5"}, {"introduced": "3"}]}]}
    rows = normalized(
        spark, line("nvd-cve-init", "CVE-2024-1000", nvd), osv("GHSA-AAAA-BBBB-0001", aliases=["CVE-2026-41001"], severity=[{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}], affected=[events]),
        line("cve-list-v5", "CVE-2024-2000", {"cveMetadata": {"cveId": "CVE-2024-2000"}, "containers": {"cna": {"affected": [{"vendor": "v", "product": "p", "versions": [{"version": "1", "status": "affected", "lessThan": "2"}, {"version": "3", "status": "unaffected"}]}]}}}),
        line("debian-security-tracker", "CVE-2024-4000", {"packages": {"o": {"releases": {"bookworm": {"status": "resolved", "fixed_version": "3.0"}, "sid": {"status": "resolved", "fixed_version": "0"}, "trixie": {"status": "open"}}}}}),
        line("nuget-advisory", "X-1", {"packageName": "N", "vulnerableRanges": ["< 1", "< 1", "> 2"], "severity": "high", "affectedProducts": ["P"], "references": ["https://a", "HTTPS://A", {"href": "https://b"}], "notes": "no link", "cwes": ["CWE-1", {"id": "CWE-2", "name": "n"}]}),
        line("cisa-kev", "CVE-2024-3000", {"cveID": "CVE-2024-3000", "vendorProject": "V", "product": "P", "dateAdded": "2024-01-01"}), line("first-epss", "CVE-2024-5", {"cve": "CVE-2024-5000", "epss": "0.5", "percentile": 0.25}),
        line("exploitdb", "EDB-1", {"sourceKey": "EDB-1", "identifiers": [{"value": "CVE-2024-1000"}], "artifactType": "poc_code"}), "", "{broken", json.dumps({"sourceCode": "osv"}),
    )
    facts = {(r["source_record_id"], r["ecosystem"], r["package_name"], r["purl"], r["version_range_raw"], r["vulnerable"]) for r in N.affected_facts(rows).collect()}
    assert facts == {
        ("CVE-2024-1000", "cpe", "p", None, ">= 1, < 2", True), ("CVE-2024-1000", "cpe", "q", None, None, False),
        ("GHSA-AAAA-BBBB-0001", "npm", "a b", "pkg:npm/a%20b", ">= 0, < 1.2", True), ("GHSA-AAAA-BBBB-0001", "npm", "a b", "pkg:npm/a%20b", ">= 2, <= 2.5", True), ("GHSA-AAAA-BBBB-0001", "npm", "a b", "pkg:npm/a%20b", ">= 3", True),
        ("CVE-2024-2000", None, "v:p", None, ">= 1, < 2", True), ("CVE-2024-4000", "debian:12", "o", "pkg:deb/debian/o", "< 3.0", True), ("CVE-2024-4000", "debian:13", "o", "pkg:deb/debian/o", ">= 0", True),
        ("X-1", "nuget", "N", "pkg:nuget/N", "< 1", True), ("X-1", "nuget", "N", "pkg:nuget/N", "> 2", True), ("X-1", "nuget", "P", None, None, True), ("CVE-2024-3000", None, "P", None, None, True), ("CVE-2024-3000", None, "V:P", None, None, True),
    }
    scores = {(r["source_record_id"], r["score"], r["severity_label"]) for r in N.severity_scores(rows).collect()}
    assert scores == {("CVE-2024-1000", 7.5, "HIGH"), ("GHSA-AAAA-BBBB-0001", 9.8, "CRITICAL"), ("X-1", None, "high")}
    assert {(r["source_record_id"], r["weakness_id"]) for r in N.record_weaknesses(rows).collect()} == {("CVE-2024-1000", "CWE-79"), ("X-1", "CWE-1"), ("X-1", "CWE-2")}
    assert {r["url"] for r in N.evidence_references(rows).where("source_record_id = 'X-1'").collect()} == {"https://a", "https://b"}
    assert {(r["score_type"], r["score"], r["vulnerability_key"]) for r in N.threat_scores(rows).collect()} == {("known-exploited", 1.0, "CVE-2024-3000"), ("epss", 0.5, "CVE-2024-5000")}
    assert [r["source_key"] for r in N.record_exploits(rows).collect()] == ["EDB-1"]
    assert {r["vulnerability_key"] for r in rows.where("source_code = 'exploitdb'").collect()} == {"CVE-2024-1000"}
    assert rows.where("source_code = 'nvd-cve'").count() == 1 and rows.count() == 8


def test_spool_files(spark, tmp_path):
    folder = str(tmp_path)
    lines = spark.createDataFrame([(json.loads(osv(f"OSV-2026-{n}", summary=f"s{n}")),) for n in range(7)], "e struct<sourceCode:string,externalKey:string,payload:struct<id:string,summary:string>>").select("e.*")
    names = write_spool(lines.coalesce(1), folder, "run", 3)
    assert names == [f"run-s{n:04d}.ndjson.ready" for n in (1, 2, 3)] and SpoolFiles(spark, folder).names() == names
    (tmp_path / "bad.ndjson.ready").write_text(osv("OSV-1-1") + "\n\n{broken\n")
    (tmp_path / "mixed.ndjson.ready").write_text(osv("OSV-1-1") + "\n" + line("ghsa", "GHSA-1111-2222-3333", {}) + "\n")
    (tmp_path / "first-epss-x.ndjson.ready").write_text("{}\n")
    scanned = scan_spool(spark, folder)
    assert scanned.where("run = 'run'").select("sequence").distinct().count() == 3
    files = SpoolFiles(spark, folder)
    judged = judge_files(scanned)
    judged = spark.createDataFrame(judged.collect(), judged.schema)
    accepted, refused = files.finish(judged)
    assert sorted(refused) == ["bad.ndjson.ready", "mixed.ndjson.ready"] and sorted(accepted) == names
    assert sorted(files.names(FAILED)) == ["bad.ndjson.failed", "mixed.ndjson.failed"]
    assert files.queue_sizes() == {"ready": 1, "processing": 0, "staged": 3, "failed": 2, "partial": 0}
    assert len(files.names(STAGED)) == 3 and files.finish(judged)[0] == accepted and files.clear_staged() == 3
    (tmp_path / f"again{PROCESSING}").write_text(osv("OSV-1-1"))
    assert files.recover() == ["again.ndjson.ready"]


def test_drain_twice_gives_the_same_state(spark, tmp_path):
    folder, store = tmp_path / "spool", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    (folder / "a-s0001.ndjson.ready").write_text("\n".join([osv("OSV-2026-1", summary="old"), osv("OSV-2026-2", summary="two", aliases=["CVE-2026-1001"])]))
    (folder / "a-s0002.ndjson.ready").write_text(line("osv", "OSV-2026-1", {"id": "OSV-2026-1", "summary": "new", "affected": AFFECTED}, recordHash="h2"))
    os.utime(folder / "a-s0001.ndjson.ready", (1_700_000_000, 1_700_000_000))  # a stream takes files by time
    keys = []
    take = lambda checkpoint: S.drain_spool(spark, str(folder), store, str(tmp_path / checkpoint), lambda k, n: keys.append({r[0] for r in k.collect()}), 1)
    assert take("c1").batches == 2
    state = lambda: sorted((r["source_record_id"], r["title"], r["vulnerability_key"]) for r in store.read("source_records").collect())
    assert state() == [("OSV-2026-1", "new", "OSV-2026-1"), ("OSV-2026-2", "two", "CVE-2026-1001")]
    assert store.read("affected_facts").count() == 1
    before = state()
    assert take("c1").batches == 0
    assert state() == before and keys[0] == {"OSV-2026-1", "CVE-2026-1001"}
    for staged in folder.glob("*.staged"):
        staged.rename(folder / f"{staged.name.removesuffix('.staged')}.ready")
    assert sorted(take("c2").accepted) == ["a-s0001.ndjson.ready", "a-s0002.ndjson.ready"]
    assert state() == before and store.read("source_record_identifiers").count() == 3


EXPLOIT_PAYLOAD = {"sourceKey": "EDB-7", "artifactType": "poc_code", "title": "poc"}


def write(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.ndjson.ready").write_text("\n".join(lines))


def test_refused_files_are_set_aside_and_reported(spark, tmp_path):
    folder, store = tmp_path / "spool", Store(spark, str(tmp_path / "store"))
    write(folder, "good", osv("OSV-2026-1", summary="one"))
    write(folder, "broken", osv("OSV-2026-2", summary="two"), "{")
    write(folder, "revision", line("nuclei-templates", "t1", {"sourceKey": "t1"}, snapshotId="r1"))
    done = S.drain_spool(spark, str(folder), store, str(tmp_path / "c"))
    assert done.accepted == ["good.ndjson.ready"] and sorted(done.refused) == ["broken.ndjson.ready", "revision.ndjson.ready"]
    assert sorted(p.name for p in folder.glob("*.ndjson.*")) == ["broken.ndjson.failed", "good.ndjson.staged", "revision.ndjson.failed"]
    assert [r["source_record_id"] for r in store.read("source_records").collect()] == ["OSV-2026-1"]


def test_exploits_and_snapshots_reach_the_store(spark, tmp_path):
    folder, store = tmp_path / "spool", Store(spark, str(tmp_path / "store"), buckets=4)
    entry = lambda key, revision, **more: line("nuclei-templates", key, {"sourceKey": key, "title": f"{key} {revision}"}, identifiers=["CVE-2026-5001"], snapshotId=revision, snapshotComplete=True, **more)
    state = lambda: {r["source_key"]: (r["title"], r["is_active"], r["snapshot_id"]) for r in store.read("exploits").collect()}
    write(folder, "n1", entry("t1", "r1"), entry("t2", "r1"), entry("t3", "r1"))
    write(folder, "e1", line("exploitdb", "7", EXPLOIT_PAYLOAD, identifiers=["CVE-2026-5002"]))
    S.drain_spool(spark, str(folder), store, str(tmp_path / "c"))
    assert state() == {"EDB-7": ("poc", True, None), **{f"t{n}": (f"t{n} r1", True, "r1") for n in (1, 2, 3)}}
    write(folder, "n2", entry("t1", "r2"), entry("t4", "r2"), entry("t5", "r2"))
    write(folder, "n3", entry("t9", "r3"))  # far smaller than the active set
    write(folder, "n4", entry("t1", "r4", sourceMode="append"))
    os.utime(folder / "n2.ndjson.ready", (1_700_000_000, 1_700_000_000))
    done = S.drain_spool(spark, str(folder), store, str(tmp_path / "c"))
    assert sorted(done.refused) == ["n3.ndjson.ready", "n4.ndjson.ready"] and done.accepted == ["n2.ndjson.ready"]
    got = state()
    assert got["t1"] == ("t1 r2", True, "r2") and got["t4"] == ("t4 r2", True, "r2") and "t9" not in got
    assert got["EDB-7"] == ("poc", True, None) and got["t2"][1] is False and got["t3"][1] is False
    assert store.read("source_records").where("source_code = 'nuclei-templates'").count() == 0


def test_initial_loads_replace_their_source(spark, tmp_path):
    folder, store = tmp_path / "spool", Store(spark, str(tmp_path / "store"), buckets=4)
    ids = lambda: sorted(r["source_record_id"] for r in store.read("source_records").collect())
    write(folder, "a", osv("OSV-2026-1", summary="one"), osv("OSV-2026-2", summary="two"))
    write(folder, "k", line("cisa-kev", "CVE-2026-1", {"cveID": "CVE-2026-1", "vulnerabilityName": "x", "dateAdded": "2026-01-01"}))
    S.drain_spool(spark, str(folder), store, str(tmp_path / "c"))
    assert ids() == ["CVE-2026-1", "OSV-2026-1", "OSV-2026-2"]
    write(folder, "b-s0001", line("osv-init", "OSV-2026-3", {"id": "OSV-2026-3", "summary": "three"}))
    write(folder, "b-s0002", line("osv-init", "OSV-2026-4", {"id": "OSV-2026-4", "summary": "four"}, sourceMode="append"))
    keys = []
    S.drain_spool(spark, str(folder), store, str(tmp_path / "c"), lambda k, n: keys.extend(r[0] for r in k.collect()))
    assert ids() == ["CVE-2026-1", "OSV-2026-3", "OSV-2026-4"] and sorted(keys) == ["OSV-2026-1", "OSV-2026-2", "OSV-2026-3", "OSV-2026-4"]


def test_projections_follow_the_drain(spark, tmp_path):
    """After keyed rebuilds the projections are those of a full one."""
    folder, store = tmp_path / "spool", Store(spark, str(tmp_path / "store"), buckets=4)
    write(folder, "a", *(osv(f"OSV-2026-{n}", summary=f"s{n}", aliases=[f"CVE-2026-{5000 + n % 3}"], affected=AFFECTED) for n in range(6)))
    assert S.drain_spool(spark, str(folder), store, str(tmp_path / "c"), rebuild=True).rebuild == "full"
    assert store.read("pending_keys").count() == 0 and store.read("vulnerabilities").count() == 3
    write(folder, "b", line("osv", "OSV-2026-1", {"id": "OSV-2026-1", "summary": "moved", "aliases": ["CVE-2026-7777"]}, recordHash="h2"), osv("OSV-2026-9", summary="new", affected=AFFECTED))
    assert S.drain_spool(spark, str(folder), store, str(tmp_path / "c"), rebuild=True).rebuild == "keyed"
    shown = lambda name: sorted(map(str, (r.asDict() for r in store.read(name).collect())))
    keyed = {n: shown(n) for n in ("vulnerabilities", "affected_components", "alias_owners")}
    assert any("CVE-2026-7777" in r for r in keyed["vulnerabilities"]) and len(keyed["vulnerabilities"]) == 5
    store.drop("vulnerabilities")
    store.publish({"pending_keys": store.read("source_records").select("vulnerability_key").distinct()})
    assert S.rebuild_projections(store) == "full"
    assert {n: shown(n) for n in keyed} == keyed


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    rows = spark.range(200).selectExpr("cast(id as string) AS k", "0 AS v")
    store.publish({"t": rows}, buckets={"t": (["k"], None)})
    before = store.manifest()["t"]["folders"]
    one = rows.where(store.bucket_of("k") == 3).withColumn("v", F.lit(1))
    store.publish({"t": one}, store.number(), {"t": (["k"], [3])})
    after = store.manifest()["t"]["folders"]
    assert {b for b in after if after[b] != before.get(b)} == {"3"} and store.read("t").count() == 200
    assert store.read("t").where("v = 1").count() == one.count() == store.read("t", buckets=[3]).count()
    store.publish({"t": one.limit(0)}, store.number(), {"t": (["k"], [3])})
    assert store.read("t").count() == 200 - one.count() and "3" not in store.manifest()["t"]["folders"]


def test_two_publishers_lose_nothing(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.publish({"t": spark.range(1), "u": spark.range(1)})
    base = store.number()
    other.publish({"u": spark.range(5)})
    store.publish({"t": spark.range(2)}, base)  # another table: both stay
    assert store.read("t").count() == 2 and store.read("u").count() == 5
    with pytest.raises(Conflict):
        store.publish({"u": spark.range(9)}, base)
    assert store.read("u").count() == 5 and len(list((tmp_path / "u").glob("v=*"))) == 1


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.manifest() == {} and not store.ready("t") and store.read("t", "a int").count() == 0
    with pytest.raises(KeyError):
        store.read("t")
    for n in range(4):
        store.publish({"t": spark.range(n + 1), "u": spark.range(1)})
    assert store.read("t").count() == 4 and store.ready("t") and len(list((tmp_path / "t").glob("v=*"))) == 2
    with pytest.raises(Exception):
        store.publish({"u": spark.range(9), "t": spark.range(3).select(F.raise_error(F.lit("x")).alias("id"))})
    assert store.read("t").count() == 4 and store.read("u").count() == 1
    store.drop("u")
    assert "u" not in store.manifest()


EXPLOIT = "source_code string, raw_index_id string, source_key string, identifiers string, title string, source_url string, artifact_type string, exploit_type string, maturity string, verification_status string, published_at string, modified_at string, snapshot_id string, is_active boolean"


def exploits(spark, *rows):
    return spark.createDataFrame([(s, r, r, "[]", t, *[None] * 7, snap, True) for s, r, t, snap in rows], EXPLOIT)


def test_snapshot_apply(spark):
    a = D.apply_snapshot(exploits(spark, ("other", "x", "t", None)), exploits(spark, ("n", "first", "t", None), ("n", "removed", "t", None)), "n", "rev-a")
    b = D.apply_snapshot(a, keep_last(exploits(spark, ("n", "first", "t2", None), ("n", "added", "t", None), ("n", "third", "t", None), ("n", "added", "t", None)), ["source_code", "raw_index_id"], ["title"]), "n", "rev-b")
    got = {r["raw_index_id"]: (r["title"], r["is_active"]) for r in b.collect()}
    assert got == {"x": ("t", True), "first": ("t2", True), "added": ("t", True), "third": ("t", True), "removed": ("t", False)}
    for bad, name in ((exploits(spark, ("n", "one", "t", None)), "rev-c"), (exploits(spark), "rev-d"), (exploits(spark, ("n", "a", "t", None), ("m", "b", "t", None)), "rev-e"), (exploits(spark, ("n", "first", "t", None)), " ")):
        with pytest.raises(ValueError):
            D.apply_snapshot(b, bad, "n", name)
    assert D.apply_snapshot(b, exploits(spark, ("n", "one", "t", None)), "n", "rev-c", override=True).where("source_code = 'n' and is_active").count() == 1


def test_score_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    feed = lambda *rows: spark.createDataFrame([(f"CVE-2024-{1000 + n}", s, 0.5, day) for n, (s, day) in enumerate(rows)], "vulnerability_key string, score double, percentile double, observed_at string")
    assert S.merge_score_batch(store, feed((0.1, "d1"), (0.2, "d1"), (0.3, "d1")))["inserted"] == 3
    assert S.merge_score_batch(store, feed((0.1, "d2"), (0.2, "d2"), (0.3, "d2")))["unchanged"] == 3
    counts = S.merge_score_batch(store, feed((0.9, "d3"), (0.2, "d3"), (0.3, "d3")))
    assert (counts["updated"], counts["unchanged"]) == (1, 2)
    assert {r["observed_at"] for r in store.read("threat_scores_epss").collect()} == {"d1", "d3"}
    with pytest.raises(ValueError):
        S.merge_score_batch(store, feed((1.1, "d4")))
    assert store.read("threat_scores_epss").count() == 3


def test_score_file_and_manifest(spark, tmp_path):
    body = gzip.compress(b"#model_version:v1,score_date:2026\ncve,epss,percentile\ncve-2024-1000,0.1,0.2\n")
    (tmp_path / "s.csv.gz").write_bytes(body)
    manifest = {"schemaVersion": 1, "sourceCode": "first-epss", "observedAt": "2026-01-01", "contentHash": hashlib.sha256(body).hexdigest(), "bytes": len(body)}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert [tuple(r) for r in feeds.verified_snapshot(spark, str(tmp_path / "s.csv.gz"), str(tmp_path / "m.json")).collect()] == [("CVE-2024-1000", 0.1, 0.2, "2026-01-01")]
    (tmp_path / "m.json").write_text(json.dumps(manifest | {"bytes": 1}))
    with pytest.raises(ValueError):
        feeds.verified_snapshot(spark, str(tmp_path / "s.csv.gz"), str(tmp_path / "m.json"))
    changed, known = feeds.content_changed(spark, str(tmp_path / "s.csv.gz"), None)
    assert changed and not feeds.content_changed(spark, str(tmp_path / "s.csv.gz"), known)[0]


def test_archives_and_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for n in range(3):
            z.writestr(f"d/GHSA-{n}.json", json.dumps({"n": n}))
        z.writestr("note.txt", "x")
    with tarfile.open(tmp_path / "all.tar.xz", "w:xz") as t:
        info = tarfile.TarInfo("a/OSV-1.json")
        info.size = 2
        t.addfile(info, io.BytesIO(b"{}"))
    assert feeds.read_archives(spark, str(tmp_path / "all.zip"), prefix="GHSA-", start=1).count() == 2
    assert [r["entry"] for r in feeds.read_archives(spark, str(tmp_path / "all.tar.xz")).collect()] == ["a/OSV-1.json"]
    (tmp_path / "docs" / "deep").mkdir(parents=True)
    (tmp_path / "docs" / "deep" / "a.md").write_text('```toml\n[advisory]\nid = "RUSTSEC-2024-0001"\npackage = "c"\n[versions]\npatched = [">= 1.2"]\n```\n# T\n')
    docs = feeds.read_documents(spark, str(tmp_path / "docs"), "*.md").withColumn("j", feeds.toml_json(F.col("body"))).withColumn("r", feeds.rust_advisory(F.col("j")))
    record = json.loads(docs.first()["r"])
    assert record["id"] == "RUSTSEC-2024-0001" and record["affected"][0]["ranges"][0]["events"] == [{"introduced": "0"}, {"fixed": "1.2"}]
    (tmp_path / "x.csv").write_text('a,b\n"1 ""q""\n2",x\n,\n')
    assert [tuple(r) for r in feeds.read_csv_rows(spark, str(tmp_path / "x.csv")).collect()] == [('1 "q"\n2', "x")]
    tracker = spark.createDataFrame([(json.dumps({"p": {"CVE-1": {"a": 1}, "other": {}}, "q": {"CVE-1": {"b": 2}}}),)], "body string")
    assert set(json.loads(feeds.regroup_tracker(tracker).first()["packages_json"])) == {"p", "q"}
    assert feeds.stable_hash('{"b":1,"a":2}') == feeds.stable_hash('{"a": 2, "b": 1}') and feeds.stable_hash("{") is None


def test_bill_of_materials(spark):
    bom = {"bomFormat": "CycloneDX", "specVersion": "1.5", "components": [
        {"type": "library", "name": "openssl", "version": "3", "purl": "pkg:deb/debian/openssl@3?distro=debian-12", "supplier": {"name": "S"},
         "properties": [{"name": "aquasecurity:trivy:SrcName", "value": "src"}, {"name": "aquasecurity:trivy:SrcVersion", "value": "3"}, {"name": "aquasecurity:trivy:SrcRelease", "value": "1"}]},
        {"name": "x", "cpe": "cpe:2.3:a:v:p:1:*:*"}]}
    rows = feeds.sbom_components(spark.createDataFrame([("s", json.dumps(bom)), ("t", "{"), ("u", None)], "sbom_id string, body string")).orderBy("place").collect()
    assert [(r["ecosystem"], r["vendor"], r["source_package_name"], r["source_package_version"], r["version"]) for r in rows] == [("debian:12", "S", "src", "3-1", "3"), ("cpe", "v", None, None, "1")]


def test_cursor(spark):
    index = spark.createDataFrame([(5, "2024-03", "c"), (6, "2024-02", "b"), (7, "2024-02", "a"), (8, "2024-01", "z")], "place int, modified_at string, id string")
    taken = S.after_cursor(index, "2024-02", ["a"])
    assert {r["id"] for r in taken.collect()} == {"c", "b"} and S.next_cursor(taken, "2024-02", ["a"]) == ("2024-03", ["c"])
    assert S.next_cursor(index.limit(0), "2024-02", ["a"]) == ("2024-02", ["a"]) and S.next_cursor(index.where("id = 'b'"), "2024-02", ["a"]) == ("2024-02", ["a", "b"])
    assert S.is_reverse_chronological(index, "place") and not S.is_reverse_chronological(index.withColumn("place", -F.col("place")), "place")
    with pytest.raises(ValueError):
        S.after_cursor(index, None, [])


def test_paged_source(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"page-{n:05d}.json").write_text(json.dumps([{"n": n}, {"n": n + 10}]))
    spark.dataSource.register(registry.PagedFeed)
    assert spark.read.format("paged_feed").option("path", str(tmp_path)).load().count() == 6
    query = spark.readStream.format("paged_feed").option("path", str(tmp_path)).load().writeStream.format("memory").queryName("pages").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("pages").count() == 6


def test_registry_and_status(spark, tmp_path):
    sources = registry.Registry()
    sources.add(registry.Source("good", lambda s, state: s.range(3)))
    sources.add(registry.Source("bad", lambda s, state: 1 / 0))
    sources.add(registry.Source("once", lambda s, state: s.range(1), "init"))
    assert sources.run_cycle(spark, {}) == {"good": {"status": "ok", "records": 3}, "bad": {"status": "failed", "error": "division by zero"}}
    (tmp_path / "a.json").write_text('{"lastRun": {"status": "ok"}}')
    (tmp_path / "b.json").write_text("{broken")
    assert {r[0]: r[1] for r in registry.source_status(spark, str(tmp_path), ["a", "b", "c"]).collect()} == {"a": "ok", "b": "invalid-state", "c": "never-run"}
    calls = []
    with pytest.raises(OSError):
        registry.with_retry(lambda: (_ for _ in ()).throw(OSError("x")), 3, 1, calls.append)
    assert calls == [1, 2]


def test_search_plans(spark):
    vulnerabilities = spark.createDataFrame([(f"id{n}", f"CVE-{2021 + n % 2}-{n:04d}", "openssl bug" if n == 17 else "x", "[]", f"2024-{n:03d}", n / 10 if n % 3 else None) for n in range(80)],
                                            "id string, primary_identifier string, title string, identifiers_json string, modified_at string, max_cvss_score double").withColumn("published_at", F.lit(None).cast("string"))
    relations = spark.createDataFrame([("id5", "GHSA-REL-1")], "vulnerability_id string, related_identifier string")
    tokens = spark.createDataFrame([("id17", "openssl"), ("id17", "bug")], "vulnerability_id string, token string")
    go = lambda q=None, **k: plan_search(vulnerabilities, tokens, relations, q, **k)
    assert go("cve-2022-0017")[0] == "point" and go("cve-2022-0017")[1].count() == 1
    assert go("CVE-2021", size=50)[0] == "year" and go("CVE-2021", size=50)[1].count() == 40
    assert go("openssl bug")[0] == "tokens" and [r["id"] for r in go("openssl bug")[1].collect()] == ["id17"]
    assert go("openss")[0] == "like" and go("openss")[1].count() == 1 and go("++")[1].count() == 0
    assert [r["id"] for r in go("GHSA-REL-1")[1].collect()] == ["id5"]
    assert go(page=600, size=200)[0] == "empty" and go(latest=vulnerabilities)[0] == "latest" and go()[1].count() == 26
    assert [r["max_cvss_score"] for r in go(sort="cvssAsc", size=3)[1].collect()] == [0.1, 0.2, 0.4, 0.5]
    assert page_bounds(0, 1000) == (0, 200, True) and like_pattern("a\\b") == "%a\\\\b%"
