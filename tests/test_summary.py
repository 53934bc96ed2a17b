from tracelake.operators import attack, summary
from tracelake.plans import rules, sigma

SEEN = "artifact_id string, rule_id string, severity string, attack array<string>, timestamp_utc string, description string, raw_data string"


def rule(name, types=(), techniques=()):
    return rules.rule_from({"id": name, "title": name, "attack": list(techniques), "scope": {"artifact_type": list(types)}, "match": [{"field": "host", "exists": True}]})


def test_chain_of_odd_detections(spark):
    rows = [("1", "A", "low", [" t1486 ", "T1486"], None, "x", None), ("2", "A", "low", ["T1486"], "2024", "x", None), ("3", "B", "low", None, "2023", "x", None), ("4", "C", "low", ["T0000", ""], "2023", "x", None)]
    tactic_of = attack.pairs_frame(spark, attack.TACTICS, "technique", "tactic")
    got = summary.chain(spark.createDataFrame(rows, SEEN), tactic_of).collect()
    assert [(r["tactic"], r["late"], r["technique"], r["hits"], r["rules"], r["first_seen"], r["last_seen"]) for r in got] == [("impact", True, "T1486", 2, ["A"], "2024", "2024")]
    assert summary.chain(spark.createDataFrame([], SEEN), tactic_of).count() == 0


def test_outcomes_without_evidence(spark):
    none = spark.createDataFrame([], "artifact_type string")
    hits = spark.createDataFrame([], "rule_id string")
    got = summary.outcomes(none, [rule("A"), rule("B", ["x"])], hits).collect()
    assert sorted((r["rule_id"], r["scanned"], r["hits"], r["outcome"]) for r in got) == [("A", 0, 0, "nothing_to_scan"), ("B", 0, 0, "nothing_to_scan")]
    # a type that two prefixes of one scope fit counts once
    some = spark.createDataFrame([("xy",), ("xy",), (None,)], "artifact_type string")
    got = {r["rule_id"]: (r["scanned"], r["outcome"]) for r in summary.outcomes(some, [rule("A"), rule("B", ["x", "xy"])], hits).collect()}
    assert got == {"A": (3, "unfired"), "B": (2, "unfired")}


def test_simulation_of_no_detections_and_no_steps(spark):
    none = spark.createDataFrame([], SEEN)
    got = summary.score_simulation(none, [summary.Action("T1", "m", ("A",)), summary.Action("T2", done=False)])
    assert [(r["state"], r["fired"], r["by"]) for r in got.orderBy("step").collect()] == [("missed", [], ""), ("skipped", [], "")]
    assert tuple(summary.simulation_rate(got).first()) == (1, 0, 1)
    assert summary.score_simulation(none, []).count() == 0
    null_raw = spark.createDataFrame([("1", "A", "low", [], None, None, "a MARKER b")], SEEN)
    assert summary.score_simulation(null_raw, [summary.Action("T1", "marker")]).first()["by"] == "marker"


def test_technique_index_of_odd_documents(spark):
    docs = [("a", {"tags": ["attack.T1059", "attack.t1059", "attack.x", 3], "detection": {}}), ("b", {"detection": {"filter": {}}, "tags": None})]
    assert [tuple(r) for r in sigma.technique_index(spark, docs).collect()] == [("T1059", 1, 0, ["a"])]
    assert sigma.technique_index(spark, []).count() == 0


def test_every_named_technique_is_placed(spark):
    tactic_of = attack.pairs_frame(spark, attack.TACTICS, "technique", "tactic")
    assert summary.unplaced_techniques([rule("A", techniques=["t1486"])], tactic_of).count() == 0
    assert summary.unplaced_techniques([], tactic_of).count() == 0
