from pyspark.sql import functions as F

from tracelake import catalog
from tracelake.operators import attack, report, store, timeline
from tracelake.plans import rules
from tracelake.streaming import counts_per_window, detect_stream, unseen, write_detections


def test_stream_finds_what_the_batch_finds(spark, tiny, tmp_path):
    a = catalog.artifacts(spark, tiny)
    a.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    which = list(catalog.META.values())
    write_detections(detect_stream(stream, which), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    key = ["artifact_id", "rule_id"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(key).collect())) == sorted(map(tuple, rules.detect(a, which).select(key).collect()))


def test_stream_drops_repeats_and_counts(spark, tiny, tmp_path):
    a = catalog.artifacts(spark, tiny)
    a.unionByName(a).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    unseen(stream).writeStream.format("memory").queryName("seen_once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("seen_once").count() == a.select("dedup_key").distinct().count()
    counts_per_window(stream, ["host"], "1 day", 1).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("windows").count() > 0


def test_exports(spark, tiny, tmp_path):
    a, d = catalog.artifacts(spark, tiny), catalog._detected(spark, tiny)
    t = store.v_timeline(a, d)
    assert timeline.export_csv(timeline.query(t, "case-a", limit=5), str(tmp_path / "t.csv")) == 5
    assert timeline.export_html(timeline.query(t, "case-a"), str(tmp_path / "t.html"), "a</script>", 10) == 10
    assert "more than 10" in (tmp_path / "t.html").read_text() and "<title>a&lt;/script&gt;" in (tmp_path / "t.html").read_text()
    cover = spark.createDataFrame([("view", "T9999"), ("err", "T1027")], "prefix string, technique string")
    layer = attack.navigator_layer(d, a, cover, str(tmp_path / "l.json"), "case")
    assert {x["techniqueID"]: x["score"] > 0 for x in layer["techniques"]}["T9999"] is False
    v = store.v_detections(d, a)
    report.write_report(str(tmp_path / "r.html"), "R", {"findings": report.findings(d), "alerts": report.alerts(v), "top": report.top_per_rule(v).select("rule_id", "artifact_id", "matched_on")})
    assert "<h2>alerts</h2>" in (tmp_path / "r.html").read_text()
    assert tuple(attack.coverage_report(d, a, cover).select("examined_clean", "unmapped_rules").first()) == (1, 1)


def test_risk_bands(spark):
    tactic = attack.pairs_frame(spark, attack.TACTICS, "technique", "tactic")
    level = lambda rows: attack.risk(spark.createDataFrame(rows, "severity string, attack array<string>"), tactic).first()["level"]
    assert level([]) == "none" and level([("low", [])]) == "low" and level([("critical", [])]) == "medium" and level([("low", ["T1486"])]) == "high"
    assert level([("low", ["T1486", "T1071.001", "T1059.001", "T1547.001", "T1070.001"])]) == "critical"


def test_unknown_layer_is_an_error(spark, tiny):
    import pytest

    with pytest.raises(ValueError, match="unknown layer"):
        timeline.query(catalog.artifacts(spark, tiny), "c", layer="nope")
    assert F is not None
