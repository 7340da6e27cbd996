import json

import pytest
from pyspark.sql import functions as F

from vulnlake.operators.sbom import newest_bills
from vulnlake.sources import feeds


@pytest.mark.parametrize("versions, events", [
    ({"patched": [">= 1.2"], "unaffected": ["< 0.5", ">= 2.0"]}, [{"fixed": "1.2"}, {"introduced": "< 0.5"}, {"introduced": "2.0"}]),
    ({"patched": "^1.2", "unaffected": "0.4"}, [{"fixed": "1.2"}, {"introduced": "0.4"}]),
    ({"patched": [], "unaffected": [">= 3"]}, [{"introduced": "3"}]), ({}, []), (None, []),
])
def test_rust_unaffected_versions(spark, versions, events):
    body = {"advisory": {"id": "RUSTSEC-2024-0001", "package": "c"}} | ({} if versions is None else {"versions": versions})
    record = json.loads(spark.createDataFrame([(json.dumps(body),)], "b string").select(feeds.rust_advisory(F.col("b"))).first()[0])
    assert record["affected"][0]["ranges"][0]["events"] == [{"introduced": "0"}, *events]


def test_csaf_list(spark):
    rows = [("R1", None, None, ["CVE-1", ""], "2024-02-01"), (None, "A2", None, None, "2024-01-01"), (None, None, "I3", None, None), (None, None, None, ["CVE-4"], "2024-03-01")]
    items = spark.createDataFrame(rows, "RHSA string, advisory string, id string, CVEs array<string>, released_on string")
    found = {r["source_key"]: r["identifiers"] for r in feeds.csaf_list_rows(items, "2024-01-01").collect()}
    assert found == {"R1": ["R1", "CVE-1"], "I3": ["I3"]}
    assert feeds.csaf_list_rows(items).count() == 3


def test_alpine_rows(spark):
    page = {"packages": [{"pkg": {"name": "a", "secfixes": {"1-r0": ["CVE-1", "CVE-2"], "2-r0": ["CVE-1", ""], "3-r0": None}}}, {"name": "b", "secfixes": {"1": ["CVE-3"]}}, {"pkg": {"name": "c"}}]}
    rows = feeds.alpine_rows(spark.createDataFrame([("v3", "main", json.dumps(page)), ("v3", "x", "{")], "release string, repo string, body string")).collect()
    assert {r["source_key"]: sorted(r["identifiers"]) for r in rows} == {"v3/main/a": ["CVE-1", "CVE-2"], "v3/main/b": ["CVE-3"], "v3/main/c": []}


def test_newest_bills(spark):
    bills = spark.range(120).select("id", F.col("id").alias("uploaded_at"))
    assert [r["id"] for r in newest_bills(bills).collect()] == list(range(119, 69, -1))
