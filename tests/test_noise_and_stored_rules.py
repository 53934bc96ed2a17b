"""Per-condition noise and Sigma documents as stored rules, against plain versions and a round trip."""

from itertools import product

import pytest
import yaml
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import assert_same
from tracelake import catalog, catalog_sigma
from tracelake.operators import noise
from tracelake.plans import rules, sigma, stored


@pytest.mark.parametrize("name", ["rule_noise_conditions", "sigma_stored_rules", "json_path_inventory", "rule_unseen_fields"])
def test_query_equals_its_sql(spark, tiny, name):
    assert_same(catalog.QUERIES[name](spark, tiny), catalog.ORACLE[name], tiny)


@pytest.mark.parametrize("name", ["rule_noise_conditions", "json_path_inventory", "rule_unseen_fields"])
def test_one_scan(spark, tiny, name):
    plan = catalog.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_noise_of_odd_rules(spark):
    df = spark.createDataFrame([("a", "t", "x"), ("b", "t", ""), ("c", "t", None), ("d", "u", "x")], "artifact_id string, artifact_type string, description string").withColumn("raw_data", F.lit(None).cast("string"))
    one = rules.rule_from({"id": "1", "title": "t", "scope": {"artifact_type": "t"}, "match": {"any": [{"field": "description", "equals": "x"}]}})
    none = rules.rule_from({"id": "2", "title": "t", "scope": {"artifact_type": "zz"}, "match": [{"field": "description", "equals": "x"}]})
    got = noise.conditions(df, [one, none]).collect()
    # without its only condition the rule matches all in scope
    assert [(r.rule_id, r.nth, r.part, r.holds, r.filled, r.seen, r.matched, r.without) for r in got] == [("1", 0, "match", 1, 1, 3, 1, 3)]
    with pytest.raises(rules.RuleError):
        noise.conditions(df, [rules.rule_from({"id": "3", "title": "t", "match": [{"field": "description", "equals": str(i)} for i in range(63)]})])


trees = st.recursive(st.sampled_from("abcd").map(lambda n: ("name", n)), lambda t: st.one_of(t.map(lambda x: ("not", x)), st.tuples(st.sampled_from(["and", "or"]), st.lists(t, min_size=1, max_size=3)), st.tuples(st.just("of"), st.integers(1, 3), st.just(["a", "b", "c"]))), max_leaves=8)


def holds(tree, on):
    if tree[0] == "name":
        return tree[1] in on
    if tree[0] == "not":
        return not holds(tree[1], on)
    if tree[0] == "of":
        return sum(n in on for n in tree[2]) >= tree[1]
    return (all if tree[0] == "and" else any)(holds(t, on) for t in tree[1])


@settings(max_examples=200, deadline=None)
@given(trees)
def test_alternatives_hold_as_the_tree_does(tree):
    found = stored.alternatives(tree)
    for bits in product([0, 1], repeat=4):
        on = {n for n, b in zip("abcd", bits, strict=True) if b}
        assert holds(tree, on) == any(a <= on and not b & on for a, b in found)


def test_stored_rules_find_the_same_rows_after_reading_them_back(spark, tiny, tmp_path):
    docs = list(yaml.safe_load_all(catalog_sigma.BRANCHED))
    docs.append({"title": "guarded", "id": "b-3", "level": "critical", "tags": ["attack.t1059.001"], "logsource": {"product": "windows", "category": "process_creation"}, "detection": {"s": [{"Image|endswith": "\\x.exe"}, {"CommandLine|contains|all": ["a", "b"], "User": ["u*", None]}], "condition": "s"}})
    bad = [{"title": "k", "id": "k", "logsource": catalog_sigma.SYSLOG, "detection": {"k": ["word"], "condition": "k"}}, {"title": "t", "id": "t", "logsource": catalog_sigma.SYSLOG, "detection": {"k": {"a": 1}, "timeframe": "1m", "condition": "k | count() > 1"}}, docs[0], {"title": "n", "id": "n", "logsource": catalog_sigma.SYSLOG, "detection": {"k": {"a": 1}, "condition": "k and not k"}}]
    written, refused = stored.translate([(f"{i}.yml", d) for i, d in enumerate([*docs, *bad])])
    assert [r[2] for r in refused] == ["keywords in a stored rule", "aggregation in a stored rule", "repeated id", "condition that never holds"]
    stored.write(spark, written, refused, str(tmp_path))
    back = stored.read(spark, str(tmp_path))
    assert sorted(r.id for r in back) == sorted(r["id"] for r in written)
    lines = catalog_sigma._lines(spark, tiny)
    payload = F.to_json(F.struct(F.lit("1").alias("EventId"), F.struct(F.struct(F.when(F.col("artifact_id").endswith("1"), "C:\\x.exe").otherwise("y").alias("Image"), F.lit("b a").alias("CommandLine"), F.when(F.col("artifact_id").endswith("2"), "u7").when(F.col("artifact_id").endswith("3"), "zz").alias("User")).alias("payload")).alias("_enrich")))
    starts = lines.select("artifact_id", "case_id", "host", F.lit("event_log").alias("artifact_type"), "description", "timestamp_utc", payload.alias("raw_data"))
    both = lines.unionByName(starts)
    found, _ = sigma.assemble(docs)
    key = ["artifact_id", "rule_title", "severity", "score"]
    direct = sorted(tuple(r) for r in sigma.detect(both, found).select(*key).distinct().collect())
    again = sorted(tuple(r) for r in rules.detect(both, back).select(*key).distinct().collect())
    assert direct == again and len({t for _, t, _, _ in direct}) == 3
    assert spark.read.csv(f"{tmp_path}/refused", header=True).count() == 4 and spark.read.csv(f"{tmp_path}/worksheet", header=True).count() == len(written)
    told = spark.read.json(f"{tmp_path}/manifest").first()
    assert (told.rules, told.refused, told.by_severity.critical) == (len(written), 4, 1)


def keys(value, prefix=""):
    return {p for k, v in value.items() for p in {prefix + k} | keys(v, f"{prefix}{k}.")} if isinstance(value, dict) else set()


objects = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.floats(-5, 5).map(lambda x: round(x, 2)), st.text("ab`<>,:. (é", max_size=4)), lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.text("ab`<>,:. (é", max_size=3), v, max_size=3)), max_leaves=12)


def test_paths_are_all_keys_of_nested_objects(spark):
    import json

    told: list = [{"a": {"b": 1, "c d": None, "e.f": {"g": [{"h": 1}, {"i": {"j": 2}}]}}, "z`q": "x"}, {"a": "s"}, [1, {"x": 1}], {}, "x", {"m": [{"p": 1}, 3], "A": 2.5, "": {"": 1}}]

    @settings(max_examples=60, deadline=None)
    @given(objects)
    def collect(value):
        told.append(value)

    collect()
    rows = [(str(i), json.dumps(v)) for i, v in enumerate(told)] + [("bad", "{"), ("none", None)]
    df = spark.createDataFrame(rows, "artifact_type string, raw_data string")
    got: dict = {}
    for r in rules.path_inventory(df).collect():
        assert r.rows == 1
        got.setdefault(r.artifact_type, set()).add(r.path)
    assert got == {str(i): keys(v) for i, v in enumerate(told) if isinstance(v, dict) and v}
