"""The rule compiler against a small interpreter written for these tests."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.plans import rules, sigma

ROWS = [
    {"artifact_id": "1", "case_id": "c", "artifact_type": "event_log", "host": "h1", "description": "PowerShell -Enc AAA", "raw_data": {"EventId": 1, "Channel": "Sysmon", "n": "1,500", "deep": {"a": {"b": "X"}}, "flag": True}},
    {"artifact_id": "2", "case_id": "c", "artifact_type": "event_log", "host": "h2", "description": "notepad", "raw_data": {"EventId": "3", "n": "x", "Binary (Registry)": "a.exe"}},
    {"artifact_id": "3", "case_id": "c", "artifact_type": "memory_process", "host": "h1", "description": None, "raw_data": {}},
    {"artifact_id": "4", "case_id": "d", "artifact_type": "process", "host": None, "description": "curl http://x", "raw_data": None},
]
SCHEMA = "artifact_id string, case_id string, artifact_type string, host string, description string, timestamp_utc string, primary_ts_type string, source string, raw_data string"


@pytest.fixture(scope="module")
def artifacts(spark):
    rows = [(r["artifact_id"], r["case_id"], r["artifact_type"], r["host"], r["description"], None, None, None, "not json" if r["raw_data"] is None else json.dumps(r["raw_data"])) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).cache()


def value(row, name):
    if not name.startswith("raw_data."):
        v = row.get(name)
    else:
        v = row["raw_data"] or {}
        for p in name.removeprefix("raw_data.").split("."):
            v = v.get(p) if isinstance(v, dict) else None
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def number(s):
    try:
        return float(s.replace(",", ""))
    except ValueError:
        return None


def holds(row, c):
    v = value(row, c["field"])
    low = v.lower()
    lows = lambda a: [str(x).lower() for x in (a if isinstance(a, list) else [a])]
    test = {
        "equals": lambda a: low == lows(a)[0], "equals_any": lambda a: low in lows(a), "contains": lambda a: lows(a)[0] in low, "contains_any": lambda a: any(x in low for x in lows(a)), "contains_all": lambda a: all(x in low for x in lows(a)),
        "startswith_any": lambda a: any(low.startswith(x) for x in lows(a)), "endswith_any": lambda a: any(low.endswith(x) for x in lows(a)), "regex": lambda a: re.search(a, v) is not None, "exists": lambda a: (v != "") == a, "is_true": lambda a: (low in ("true", "1", "yes")) == a,
        "gt": lambda a: number(v) is not None and number(v) > a, "lt": lambda a: number(v) is not None and number(v) < a,
    }
    return all(test[k](a) for k, a in c.items() if k != "field")


def block(row, b):
    if isinstance(b, list):
        b = {"all": b}
    if "field" in b:
        return holds(row, b)
    return all(block(row, x) for x in b.get("all", [])) and (not b.get("any") or any(block(row, x) for x in b["any"]))


FIELDS = ["artifact_type", "host", "description", "raw_data.EventId", "raw_data.n", "raw_data.deep.a.b", "raw_data.flag", "raw_data.none"]
WORDS = st.sampled_from(["1", "h1", "X", "e", "event_log", "CURL", "1,500", "", "shell"])
CONDITION = st.builds(
    lambda f, o: {"field": f, o[0]: o[1]}, st.sampled_from(FIELDS),
    st.one_of(st.tuples(st.sampled_from(["equals", "contains"]), WORDS), st.tuples(st.sampled_from(["equals_any", "contains_any", "contains_all", "startswith_any", "endswith_any"]), st.lists(WORDS, min_size=1, max_size=2)), st.tuples(st.sampled_from(["exists", "is_true"]), st.booleans()), st.tuples(st.sampled_from(["gt", "lt"]), st.integers(0, 2000)), st.tuples(st.just("regex"), st.sampled_from(["^1$", "(?i)POWER", "h\\d"]))),
)
BLOCK = st.recursive(CONDITION, lambda b: st.one_of(st.lists(b, min_size=1, max_size=2), st.fixed_dictionaries({"any": st.lists(b, min_size=1, max_size=2)}), st.fixed_dictionaries({"all": st.lists(b, min_size=1, max_size=2), "any": st.lists(b, min_size=1, max_size=2)})), max_leaves=4)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(BLOCK, st.lists(CONDITION, max_size=1)), min_size=6, max_size=6))
def test_compiled_rules_agree_with_the_interpreter(artifacts, blocks):
    made = [rules.rule_from({"id": f"r{i}", "title": "t", "match": b if isinstance(b, list) or "field" not in b else [b], "exclude": x}) for i, (b, x) in enumerate(blocks)]
    got = {(r["artifact_id"], r["rule_id"]) for r in rules.matches(artifacts, made, ["artifact_id"]).collect()}
    want = {(row["artifact_id"], f"r{i}") for row in ROWS for i, (b, x) in enumerate(blocks) if block(row, b) and not any(block(row, e) for e in x)}
    assert got == want


def test_explanations_and_scores(artifacts):
    r = rules.rule_from({"id": "a", "title": "T", "severity": "high", "attack": ["T1"], "scope": {"artifact_type": ["event"]}, "match": {"all": [{"field": "raw_data.EventId", "exists": True}], "any": [{"field": "host", "equals": "h9"}, {"field": "description", "contains": "note"}]}})
    row = rules.detect(artifacts, [r]).collect()[0]
    assert (row["artifact_id"], row["matched_on"], row["score"], row["attack"]) == ("2", "raw_data.EventId=3 | description=notepad", 40, ["T1"])


def test_guarded_rules_and_odd_keys(artifacts):
    made = rules.load_rules(["id: g\ntitle: t\nmatch:\n  - {field: raw_data.EventId, equals: 1}\n  - {field: description, contains: powershell}\n---\nid: k\ntitle: t\nmatch: [{field: 'raw_data.Binary (Registry)', equals: A.EXE}]\n"])
    assert {(r["artifact_id"], r["rule_id"]) for r in rules.detect(artifacts, made).collect()} == {("1", "g"), ("2", "k")}


@pytest.mark.parametrize("text", ["id: a\ntitle: t\n", "id: a\ntitle: t\nmatch: [{equals: x}]", "id: a\ntitle: t\nmatch: [{field: host, like: x}]", "id: a\ntitle: t\nid: b\nmatch: [{field: host, equals: x}]", "id: a\ntitle: t\nmatch: [{field: host, equals: x}]\n---\nid: a\ntitle: t\nmatch: [{field: host, equals: x}]"])
def test_bad_rules_are_refused(spark, text):
    with pytest.raises(rules.RuleError):
        rules.validate(rules.load_rules([text]))


def test_empty_table(artifacts):
    r = rules.rule_from({"id": "a", "title": "t", "match": [{"field": "host", "exists": True}]})
    assert rules.detect(artifacts.where("false"), [r]).count() == 0


def test_unseen_fields(artifacts):
    r = rules.rule_from({"id": "a", "title": "t", "scope": {"artifact_type": ["event_log"]}, "match": [{"field": "raw_data.deep.a.b", "equals": "x"}, {"field": "raw_data.nope", "equals": "x"}]})
    assert [tuple(x) for x in rules.unseen_fields(artifacts.where("artifact_id <> '4'"), [r]).collect()] == [("a", "raw_data.nope")]


# --- Sigma ---------------------------------------------------------------------------------------------------------

def matched(artifacts, detection, **more):
    doc = {"id": "u", "title": "t", "level": "high", "detection": detection} | more
    return sorted(r["artifact_id"] for r in sigma.matching(artifacts, sigma.compile_sigma(doc, {"type": "artifact_type", "text": "description"})).collect())


@pytest.mark.parametrize(("detection", "want"), [
    ({"s": {"type": "event_log"}, "f": {"text|contains": ["powershell"], "EventId": 1}, "condition": "s and not f"}, ["2"]),
    ({"a": {"text|startswith": "power"}, "b": {"text|endswith": "://x"}, "condition": "1 of them"}, ["1", "4"]),
    ({"a1": {"type": "event_log"}, "a2": {"text": "n?te*"}, "condition": "all of a*"}, ["2"]),
    ({"a": {"text|windash|contains": " /enc"}, "condition": "a"}, ["1"]),
    ({"a": [{"EventId": 3}, {"text|re": "^curl"}], "condition": "not (not a)"}, ["2", "4"]),
    ({"a": {"Channel": None}, "b": {"type": "event_log"}, "condition": "a and b or b and not a and not b"}, ["2"]),
    ({"a": {"text|contains|all": ["curl", "http"]}, "condition": "a"}, ["4"]),
])
def test_sigma_conditions(artifacts, detection, want):
    assert matched(artifacts, detection) == want


@pytest.mark.parametrize("detection", [{"a": {"x|cidr": "1.0.0.0/8x"}, "condition": "a"}, {"a": {"x|base64offset": "y*"}, "condition": "a"}, {"a": {"x": 1}, "condition": "a | count() > 3"}, {"a": {"x": 1}, "condition": "a | max(x) > 3", "timeframe": "1h"}, {"a": {"x": 1}, "condition": "a | near b", "timeframe": "1h"}, {"a": {"x": 1}, "condition": "a", "timeframe": "1h"}, {"a": {"x|expand": "%none%"}, "condition": "a"}, {"a": {"x|rot13": "v"}, "condition": "a"}, {"a": {"x": 1}, "condition": "b"}, {"a": {"x": 1}, "condition": "(a"}])
def test_sigma_refusals(spark, detection):
    with pytest.raises(sigma.Refused):
        sigma.compile_sigma({"id": "u", "title": "t", "detection": detection}, {})


def test_sigma_corpus(spark):
    docs = [{"id": "1", "title": "a", "status": "stable", "level": "high", "tags": ["attack.t1059"], "detection": {"s": {"x": 1}, "condition": "s"}}, {"id": "2", "title": "b", "status": "test", "detection": {"s": {"x|cidr": "y"}, "condition": "s"}}, {"id": "3", "title": "c", "status": "experimental", "detection": {}}]
    done, refused = sigma.translate_corpus(docs, {})
    assert [r.rule.attack for r in done] == [("T1059",)] and [i for i, why in refused if why.startswith("range")] == ["2"]
    assert F is not None


def test_sigma_in_one_scan_and_verified(spark, tmp_path):
    """Documents of a folder, in the scope and under the guards of their log sources; the scan agrees with each document alone."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.yml").write_text("title: A\nid: '1'\nlevel: high\nlogsource: {product: windows, category: process_creation}\ndetection: {s: {Image|endswith: '\\x.exe'}, condition: s}\n---\ntitle: B\nid: '2'\nlogsource: {product: linux, service: sudo}\ndetection: {s: {nope: 1}, condition: not s}\n")
    (tmp_path / "two.yaml").write_text("title: C\nid: '3'\nlogsource: {product: windows, service: sysmon}\ndetection: {s: {a: 1}, condition: s}\n")
    docs = [doc for _, doc in sigma.read_corpus(spark, str(tmp_path))]
    found, refused = sigma.assemble(docs)
    assert sorted(r.rule.title for r in found) == ["A", "B"] and refused == [("3", "log source windows/sysmon isn't collected")]
    raw = '{"EventId": "%s", "_enrich": {"payload": {"Image": "C:\\\\X.EXE"}}}'
    df = spark.createDataFrame([("1", "event_log", raw % 1), ("2", "event_log", raw % 3), ("3", "mft_file", raw % 1), ("4", "auth_log", "{}")], "artifact_id string, artifact_type string, raw_data string").withColumn("case_id", F.lit("c"))
    got = {(r["artifact_id"], r["rule_title"], r["matched_on"]) for r in sigma.detect(df, found).collect()}
    assert got == {("1", "A", "raw_data._enrich.payload.Image=C:\\X.EXE"), ("4", "B", "")}
    state = {r["rule_id"]: (r["state"], r["missing"]) for r in sigma.verify(df, found).collect()}
    assert state == {sigma.stable_id("1"): ("verified", []), sigma.stable_id("2"): ("absent", ["raw_data.nope"])}
    assert sigma.detect(df, []).count() == 0
