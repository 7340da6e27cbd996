from vulnlake.plans.domain import view


def test_score_views_grow_with_events(spark, tmp_path):
    spark.range(99_000, 103_000).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    for name, left_out in (("v_threat", 3), ("v_threat_new", 4)):
        rows = view(spark, str(tmp_path), name)
        wanted = [n for n in range(99_000, 103_000) if n % left_out]
        assert sorted(int(r[0].split("-")[-1]) for r in rows.select("vulnerability_key").collect()) == wanted
        assert rows.where(~rows["vulnerability_key"].rlike("^CVE-[0-9]{4}-[0-9]{5,}$")).count() == 0
