"""Queries of case summaries, rulesets and simulated attacks over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake import catalog
from tracelake.catalog import DET, EV, META
from tracelake.operators import attack, store, summary
from tracelake.plans import rules, sigma
from tracelake.registry import register, table

#: A rule whose scope no event has, and one that can't fire in its scope.
_MORE = [rules.rule_from({"id": i, "title": i, "scope": {"artifact_type": [t]}, "attack": [a], "match": [{"field": "host", "equals": "nowhere"}]}) for i, t, a in (("R8", "signup", "T1136"), ("R9", "memory_", "T9998"), ("R7", "memory_process", "T9999"))]


def _detected(spark, d):
    return rules.detect(catalog.artifacts(spark, d), [*META.values(), *_MORE])


def _v_detections(spark, d):
    a = catalog.artifacts(spark, d)
    return store.v_detections(_detected(spark, d), a).join(a.select("artifact_id", "raw_data"), "artifact_id")


@register("rule_outcomes", f"""WITH {DET}, told AS (SELECT * FROM (VALUES ('R1', ['error']), ('R2', ['']), ('R3', ['']), ('R4', ['click', 'err']), ('R8', ['signup']), ('R9', ['memory_']), ('R7', ['memory_process'])) v(rule_id, scope)),
s AS (SELECT t.rule_id, count(e.artifact_id) AS scanned FROM told t LEFT JOIN ev e ON list_bool_or([starts_with(e.artifact_type, x) FOR x IN t.scope]) GROUP BY ALL), h AS (SELECT rule_id, count(*) AS hits FROM det GROUP BY ALL)
SELECT s.rule_id, scanned, coalesce(hits, 0) AS hits, CASE WHEN scanned = 0 THEN 'nothing_to_scan' WHEN coalesce(hits, 0) > 0 THEN 'fired' ELSE 'unfired' END AS outcome FROM s LEFT JOIN h USING (rule_id)""")
def rule_outcomes(spark, d):
    return summary.outcomes(catalog.artifacts(spark, d), [*META.values(), *_MORE], _detected(spark, d))


_STAGES = "(VALUES " + ", ".join(f"({i}, '{t}', {str(t in attack.LATE).upper()})" for i, t in enumerate(attack.TACTIC_ORDER, 1)) + ") st(stage, tactic, late)"
_TACTICS = catalog._pairs(attack.TACTICS, "technique", "tactic")


@register("attack_chain", f"""WITH {DET}, t AS (SELECT upper(x) AS technique, rule_id, timestamp_utc FROM (SELECT unnest(attack) AS x, rule_id, timestamp_utc FROM det))
SELECT CAST(stage AS INT) AS stage, tactic, late, technique, count(*) AS hits, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS rules, min(timestamp_utc) AS first_seen, max(timestamp_utc) AS last_seen FROM t JOIN {_TACTICS} USING (technique) JOIN {_STAGES} USING (tactic) GROUP BY ALL""")
def attack_chain(spark, d):
    seen = store.v_detections(_detected(spark, d), catalog.artifacts(spark, d))
    return summary.chain(seen, attack.pairs_frame(spark, attack.TACTICS, "technique", "tactic")).withColumn("rules", F.array_join("rules", ","))


@register("recommended_actions", f"WITH {DET} SELECT rule_id, count(*) AS hits, 'isolate' AS action, 'first' AS because FROM det WHERE rule_id = 'R1' GROUP BY ALL")
def recommended_actions(spark, d):
    """Only rules that fired have advice in the result."""
    advice = spark.createDataFrame([("R1", "isolate", "first"), ("R9", "never", "it can't fire")], "rule_id string, action string, because string")
    return summary.actions(_detected(spark, d), advice)


@register("wanted_types", f"""WITH {EV}, told AS (SELECT * FROM (VALUES ('W1', 'error'), ('W1', 'memory_'), ('W2', 'memory_'), ('W2', 'srum_'), ('W3', 'memory_')) v(rule_id, scope)),
blocked AS (SELECT rule_id FROM told t LEFT JOIN (SELECT DISTINCT artifact_type FROM ev) e ON starts_with(e.artifact_type, t.scope) GROUP BY rule_id HAVING count(e.artifact_type) = 0)
SELECT scope AS artifact_type, count(*) AS rules_blocked FROM told WHERE rule_id IN (SELECT rule_id FROM blocked) GROUP BY ALL""")
def wanted_types(spark, d):
    which = [rules.rule_from({"id": i, "title": i, "scope": {"artifact_type": t}, "match": [{"field": "host", "exists": True}]}) for i, t in (("W1", ["error", "memory_"]), ("W2", ["memory_", "srum_"]), ("W3", ["memory_"]))]
    return summary.wanted_types(rules.coverage(which, catalog.artifacts(spark, d)))


@register("unplaced_techniques", f"""SELECT technique, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM (VALUES {", ".join(f"('{t}', '{r.id}')" for r in [*META.values(), *_MORE] for t in r.attack)}) v(technique, rule_id) WHERE technique NOT IN (SELECT technique FROM {_TACTICS}) GROUP BY ALL""")
def unplaced_techniques(spark, d):
    found = summary.unplaced_techniques([*META.values(), *_MORE], attack.pairs_frame(spark, attack.TACTICS, "technique", "tactic"))
    return found.withColumn("rules", F.array_join("rules", ","))


@register("triage_queue", """WITH g AS (SELECT 'guid:g' || o_custkey AS key, CAST(count(DISTINCT substr(o_orderpriority, 1, 1)) AS INT) AS rules, CAST(sum(DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT)) AS BIGINT) AS score FROM orders GROUP BY 1)
SELECT key, rules, score FROM g WHERE rules >= 2 ORDER BY score DESC, rules DESC, key LIMIT 10""")
def triage_queue(spark, d):
    """Orders as detections of the rule that their priority names, worth its number, on one process a customer."""
    o = table(spark, d, "orders")
    raw = F.expr("to_json(named_struct('_enrich', named_struct('payload', named_struct('ProcessGuid', 'g' || o_custkey))))")
    key, rule = F.concat("o_orderkey", F.lit("-"), "o_custkey"), F.substring("o_orderpriority", 1, 1)
    a = o.select(key.alias("artifact_id"), F.lit("h").alias("host"), F.lit("event_log").alias("artifact_type"), F.lit("t").alias("timestamp_utc"), raw.alias("raw_data"))
    found = o.select(key.alias("artifact_id"), F.lit("case-a").alias("case_id"), rule.alias("rule_id"), F.lit("low").alias("severity"), rule.cast("int").alias("score"), F.array().cast("array<string>").alias("attack"))
    return summary.triage_queue(found, a).select("key", F.col("rule_count").cast("int").alias("rules"), F.col("score").cast("long").alias("score"))


_STEPS = [summary.Action("T1059.001", "BY USER 12", ("R1",)), summary.Action("T1204.002", '"k": 7', ("R9",)), summary.Action("T1027", "", ("R1", "R3")), summary.Action("T1105", "no such text", ("R9",)), summary.Action("T1003", "user", ("R1",), done=False)]
_STEPS_SQL = [("contains(t, 'by user 12')", "rule_id IN ('R1')", True), ("contains(t, '\"k\": 7')", "rule_id IN ('R9')", True), ("false", "rule_id IN ('R1', 'R3')", True), ("contains(t, 'no such text')", "rule_id IN ('R9')", True), ("contains(t, 'user')", "rule_id IN ('R1')", False)]


@register("simulation_score", f"WITH {DET}, x AS (SELECT d.rule_id, lower(d.description || chr(10) || e.props) AS t FROM det d JOIN ev e USING (artifact_id)), y AS (" + " UNION ALL ".join(
    f"SELECT {i} AS step, '{s.technique}' AS technique, {done} AS done, count(*) FILTER ({marked}) AS m, count(*) FILTER ({asked}) AS a, coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FILTER (({marked}) OR {asked}), '') AS fired FROM x" for i, (s, (marked, asked, done)) in enumerate(zip(_STEPS, _STEPS_SQL, strict=True))
) + ") SELECT CAST(step AS INT) AS step, technique, CASE WHEN NOT done THEN 'skipped' WHEN m + a > 0 THEN 'detected' ELSE 'missed' END AS state, CASE WHEN done THEN fired ELSE '' END AS fired, CASE WHEN NOT done THEN '' WHEN m > 0 THEN 'marker' WHEN a > 0 THEN 'rule' ELSE '' END AS by FROM y")
def simulation_score(spark, d):
    """Five steps of an attack against the detections: by marker, by expected rule, missed and skipped."""
    return summary.score_simulation(_v_detections(spark, d), _STEPS).withColumn("fired", F.array_join("fired", ","))


@register("sigma_technique_index", """SELECT technique, count(*) AS rules, count(*) FILTER (f) AS with_filter FROM (VALUES ('T1059.001', false), ('T1059.001', true), ('T1070.001', false), ('T1105', true)) v(technique, f) GROUP BY ALL""")
def sigma_technique_index(spark, d):
    docs = [("a.yml", {"tags": ["attack.t1059.001", "attack.execution"], "detection": {"s": {"a": 1}, "condition": "s"}}), ("b.yml", {"tags": ["attack.T1059.001", "attack.t1105"], "detection": {"s": {"a": 1}, "filter_x": {"b": 2}, "condition": "s and not filter_x"}}), ("c.yml", {"tags": ["attack.t1070.001"], "detection": {"s": {"a": 1}, "condition": "s"}}), ("d.yml", {"detection": {"condition": "s"}})]
    return sigma.technique_index(spark, docs).select("technique", "rules", "with_filter")
