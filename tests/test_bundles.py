import json

from pyspark.sql import functions as F

from vulnlake.operators import bundles as U
from vulnlake.plans.domain import view
from vulnlake.queries.catalog import _catalog


def test_response_object(spark):
    texts = ['{"a": 1}', '```json\n{"a": 1}\n```', "```\n{\"a\": 1}\n``` ", "[1]", "no json", "", None]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").withColumn("o", U.response_object(F.col("t"))).orderBy("n").collect()
    assert [r["o"] for r in rows] == ['{"a":1}'] * 3 + [None] * 4


def test_bundles_fit_and_are_cached_by_content(spark, sf):
    catalog = _catalog(spark, sf)[0]
    tables = [view(spark, sf, v) for v in ("v_facts", "v_severity", "v_references", "v_weaknesses")]
    wide = U.evidence_bundles(catalog, *tables)
    small = U.evidence_bundles(catalog, *tables, budget=3000)
    assert wide.count() == catalog.count() and small.where("input_chars > 3000").count() == 0
    first = wide.orderBy("vulnerability_key").first()
    assert json.loads(first["input_json"])["vulnerability"]["vulnerability_key"] == first["vulnerability_key"]
    key = first["vulnerability_key"]
    analyses = spark.createDataFrame(
        [(key, "v1", first["evidence_hash"], "{}", 2), (key, "v1", "old", "{}", 1), ("other", "v1", "x", "{}", 1)],
        "vulnerability_key string, prompt_version string, evidence_hash string, analysis_json string, updated_at long",
    )
    assert [r["vulnerability_key"] for r in U.cached_analyses(wide, analyses, "v1").where("is_cached").collect()] == [key]
    assert U.cached_analyses(wide, analyses, "v2").where("is_cached").count() == 0
