import json
import os

import pytest
from pyspark.sql import functions as F

from tracelake import __main__ as commands
from tracelake.operators import store
from tracelake.sources import manifest, yara
from tests.test_yara import RULES

CSV = "EventId,Channel,MapDescription,Provider,UserName,TimeCreated,Payload\n1,Sysmon,started,Prov,me,2024-03-14 10:00:00,\n3,Sysmon,,Prov,me,2024-03-14 11:00:00,\n"
YAML = """
id: A1
title: a start
severity: critical
attack: [T1059.001]
scope: {artifact_type: event_log}
match: [{field: raw_data.EventId, equals: "1"}]
---
id: A2
title: memory only
scope: {artifact_type: memory_}
match: [{field: host, exists: true}]
"""


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture
def run(spark, tmp_path, capsys):
    put(f"{tmp_path}/in/1_EvtxECmd_Output.csv", CSV)
    put(f"{tmp_path}/rules/sub/a.yaml", YAML)

    def one(command, *more, case="c 1"):
        commands.main(["--store", f"{tmp_path}/store", command, "--case", case, *more])
        return capsys.readouterr().out

    return one


def test_a_case_from_tables_to_report(spark, tmp_path, run):
    src, which = f"{tmp_path}/in", f"{tmp_path}/rules"
    for _ in range(2):  # a second ingest replaces the first
        assert "event_log" in run("ingest", src, "--kind", "tables", "--host", "h")
    tables = store.Store(spark, f"{tmp_path}/store")
    assert tables.read("artifacts").count() == 2 and tables.read("evidence").count() == 1
    for _ in range(2):
        assert "a start" in run("detect", "--rules", which)
    assert [tuple(r) for r in tables.read("detections").select("rule_id", "engine").collect()] == [("A1", "rules")]
    assert "blocked" in run("coverage", "--rules", which) and "memory_" in run("coverage", "--rules", which)
    assert "2024-03-14T10" in run("timeline", "--flagged") and "2024-03-14T11" not in run("timeline", "--flagged")
    assert "event_log" in run("stats")
    run("clusters")
    assert "fewer" in run("compare", "--baseline", "c 1", case="other")
    run("report", "--out", f"{tmp_path}/out", "--rules", which)
    page = (tmp_path / "out" / "report.html").read_text()
    assert all(f"<h2>{name}</h2>" in page for name in ("Case", "Risk", "Alerts", "Triage queue", "Evidence", "Scope", "Outcomes", "Process clusters", "Indicators", "Findings", "Attack chain", "Coverage"))
    assert "nothing_to_scan" in page and "T1059.001" in page
    assert json.loads((tmp_path / "out" / "layer.json").read_text())["techniques"]
    # rules that no longer fire leave nothing behind
    put(f"{tmp_path}/rules/sub/a.yaml", YAML.replace('"1"', '"77"'))
    run("detect", "--rules", which)
    assert tables.read("detections").count() == 0


def test_drop_spells_values_as_spark_does(spark, tmp_path):
    tables = store.Store(spark, str(tmp_path / "s"))
    rows = [("a", case, "x/y", "R", "t", "low", 1, ["T1"], "m") for case in ("c:1 %", "d^{2}")]
    tables.replace("detections", spark.createDataFrame(rows, store.model.DETECTION))
    tables.drop("detections", case_id="c:1 %", engine="x/y")
    assert [r["case_id"] for r in tables.read("detections").collect()] == ["d^{2}"]
    tables.drop("detections", case_id="absent", engine="x/y")


def test_latest_run(spark, tmp_path):
    assert manifest.latest_run(spark, str(tmp_path / "none")) is None and manifest.latest_run(spark, str(tmp_path)) is None
    for name in ("20240101T000000Z", "20240301T000000Z", "zzz"):
        (tmp_path / name).mkdir()
    (tmp_path / "20250101T000000Z").write_text("a file")
    assert manifest.latest_run(spark, str(tmp_path)).endswith("/20240301T000000Z")
    assert [p.rsplit("/", 1)[1] for p in manifest.runs(spark, str(tmp_path))] == ["20240101T000000Z", "20240301T000000Z", "zzz"]
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "b").mkdir()
    assert manifest.latest_run(spark, str(tmp_path / "only")).endswith("/b")


def test_ruleset_triage(spark, tmp_path, run):
    put(f"{tmp_path}/y/b.yara", RULES + '\nrule Text { condition: true }\nrule Top { meta: severity = "critical" condition: true }')
    put(f"{tmp_path}/y/sub/c.yar", "rule Broken { condition: true")
    put(f"{tmp_path}/y/notes.txt", "rule No { condition: true }")
    found = yara.ruleset(spark, f"{tmp_path}/y").cache()
    assert tuple(yara.triage(found).first()) == (5, 2, 3, 1, 1, 1, 1)
    assert {r["reason"]: r["n"] for r in yara.file_only_reasons(found).collect()} == {"pe module": 1, "filesize": 1, "offset anchor 'at 0'": 1}
    assert [r["name"] for r in yara.first_rules(found, "memory").collect()] == ["Top", "Text", "Regex"]
    assert [r["name"] for r in yara.first_rules(found, "memory", 1).collect()] == ["Top"]
    assert found.where(F.col("refused").isNotNull() & (F.col("name") == "Modules")).count() == 1
    commands.main(["--store", str(tmp_path), "rules", "--yara", f"{tmp_path}/y"])


# --- the store's commits ---------------------------------------------------------------------------------------

def artifact(key, source, host="h", case="c 1"):
    return (key, source, case, host, "s", "event_log", f"d{key}", "2024-03-14T10:00:00.000000Z", "seen", False, key, "{}", [])


def detection(key, engine="rules", case="c 1"):
    return (key, case, engine, "R", "t", "low", 1, ["T1"], "m")


@pytest.fixture
def tables(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "st"))


def made(spark, rows, schema=store.model.ARTIFACT):
    return spark.createDataFrame(rows, schema)


def held(tables, name="artifacts"):
    return sorted((r.artifact_id, r.source_id if name == "artifacts" else r.engine) for r in tables.read(name).collect())


def test_an_artifact_of_two_sources_is_stored_once(spark, tables):
    tables.put_source("c 1", "a", made(spark, [artifact("1", "a"), artifact("2", "a"), artifact("2", "a")]))
    tables.put_source("c 1", "b", made(spark, [artifact("2", "b"), artifact("3", "b")]))
    tables.put_source("c 2", "b", made(spark, [artifact("2", "b", case="c 2")]))
    assert held(tables) == [("1", "a"), ("2", "a"), ("2", "b"), ("3", "b")]
    assert tables.read("artifacts").where("case_id = 'c 1' and artifact_id = '2'").count() == 1


def test_a_source_read_again_takes_its_detections_along(spark, tables):
    tables.put_source("c 1", "a", made(spark, [artifact("1", "a"), artifact("2", "a")]))
    tables.put_source("c 1", "b", made(spark, [artifact("3", "b")]))
    tables.put_detections("c 1", "rules", made(spark, [detection("1"), detection("3")], store.model.DETECTION))
    tables.put_detections("c 1", "ioc", made(spark, [detection("2", "ioc")], store.model.DETECTION))
    tables.put_source("c 1", "a", made(spark, [artifact("1", "a")]))
    assert held(tables) == [("1", "a"), ("3", "b")] and held(tables, "detections") == [("3", "rules")]
    tables.put_source("c 1", "b", None)
    assert held(tables) == [("1", "a")] and held(tables, "detections") == []


def test_detecting_on_a_host_leaves_the_others(spark, tables):
    tables.put_source("c 1", "a", made(spark, [artifact("1", "a", "x"), artifact("2", "a", "y")]))
    tables.put_detections("c 1", "rules", made(spark, [detection("1"), detection("2")], store.model.DETECTION))
    tables.put_detections("c 1", "rules", made(spark, [], store.model.DETECTION), host="x")
    assert held(tables, "detections") == [("2", "rules")]


@pytest.mark.parametrize("steps", range(7))
def test_a_job_that_dies_leaves_old_or_new_rows(spark, tables, monkeypatch, steps):
    """The commit is interrupted after some of its deletions and moves; the next reader finishes or never sees it."""
    tables.put_source("c 1", "a", made(spark, [artifact("1", "a")]))
    tables.put_detections("c 1", "rules", made(spark, [detection("1")], store.model.DETECTION))
    done = []

    def dying(method):
        def step(self, *args):
            if len(done) >= steps:
                raise KeyboardInterrupt
            done.append(args)
            return method(self, *args)

        return step

    with monkeypatch.context() as m:
        m.setattr(store.Store, "_move", dying(store.Store._move))
        m.setattr(store.Store, "_delete", dying(store.Store._delete))
        try:
            tables.put_source("c 1", "a", made(spark, [artifact("1", "a"), artifact("9", "a")]))
        except KeyboardInterrupt:
            pass
    again = store.Store(spark, tables.root)
    if steps == 0:  # before the rename that commits
        assert held(again) == [("1", "a")] and held(again, "detections") == [("1", "rules")]
    else:
        assert held(again) == [("1", "a"), ("9", "a")] and held(again, "detections") == []
    assert not [n for n in os.listdir(tables.root) if n.startswith("_ready-")]


def test_content_rules_and_memory_results_by_command(spark, tmp_path, run):
    put(f"{tmp_path}/y/a.yar", 'rule Evil { meta: severity = "critical" attack = "T1027" strings: $a = "evil" condition: $a }')
    put(f"{tmp_path}/files/x/one.txt", "so evil")
    put(f"{tmp_path}/files/two.txt", "fine")
    put(f"{tmp_path}/mem/windows.pslist.json", "[]")
    commands.main(["--store", f"{tmp_path}/store", "init"])
    for _ in range(2):
        assert "Evil" in run("detect", "--host", "h", "--yara", f"{tmp_path}/y", "--files", f"{tmp_path}/files")
    tables = store.Store(spark, f"{tmp_path}/store")
    assert [(r.rule_id, r.severity, r.attack) for r in tables.read("detections").where("engine = 'yara'").collect()] == [("Evil", "critical", ["T1027"])]
    assert [r.artifact_type for r in tables.read("artifacts").collect()] == ["yara_file_hit"]
    out = run("pipeline", f"{tmp_path}/in", "--kind", "tables", "--host", "h", "--rules", f"{tmp_path}/rules", "--out", f"{tmp_path}/out")
    assert "a start" in out and (tmp_path / "out" / "report.html").exists()


def test_a_report_says_what_it_leaves_out(spark, tmp_path):
    from tracelake.operators import report

    report.write_report(f"{tmp_path}/r.html", "t", {"All": spark.range(5), "More": spark.range(9)}, most=5)
    page = (tmp_path / "r.html").read_text()
    assert page.count("rows are shown") == 1 and "5 of 9 rows are shown" in page
