"""Registry of the queries over the driver's tables and of their SQL twins.

The driver's tables have no forensic columns, so ``events`` plays the artifact table (an
event is an artifact of type event_type on host host-<n>, in case case-a or case-b, with
props as raw_data), ``orders`` and ``customer`` play process tables, and ``documents`` and
``pages`` supply text with addresses and URLs. Each query runs the engine's own operator.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import catalog_evidence, catalog_sigma  # noqa: F401  # register their queries
from tracelake import functions as fn
from tracelake.operators import attack, cluster, correlate, ioc, store, timeline
from tracelake.plans import rules, sigma
from tracelake.registry import ORACLE, QUERIES  # noqa: F401  # the driver reads both here
from tracelake.registry import register as _register
from tracelake.registry import table as _table

# --- events as artifacts -------------------------------------------------------------------------------

def artifacts(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    stamp = F.struct(F.lit("seen").alias("ts_type"), ts.alias("ts_utc"), F.lit(True).alias("is_primary"))
    return e.select(
        F.col("event_id").cast("string").alias("artifact_id"), F.lit("s1").alias("source_id"), F.when(F.col("user_id") % 2 == 0, "case-a").otherwise("case-b").alias("case_id"),
        F.concat(F.lit("host-"), (F.col("user_id") % 7).cast("string")).alias("host"), F.lit("events").alias("source"), F.col("event_type").alias("artifact_type"),
        F.concat(F.initcap("event_type"), F.lit(" by user "), F.col("user_id").cast("string")).alias("description"), ts.alias("timestamp_utc"), F.lit("seen").alias("primary_ts_type"),
        (F.get_json_object("props", "$.k").cast("int") % 10 == 0).alias("is_noise"), F.sha1(F.concat_ws("\x1f", "event_type", F.col("user_id").cast("string"), "props")).alias("dedup_key"), F.col("props").alias("raw_data"), F.array(stamp).alias("events"),
    )


EV = """ev AS (SELECT CAST(event_id AS VARCHAR) AS artifact_id, CASE WHEN user_id % 2 = 0 THEN 'case-a' ELSE 'case-b' END AS case_id, 'host-' || (user_id % 7) AS host,
    event_type AS artifact_type, upper(event_type[1]) || event_type[2:] || ' by user ' || user_id AS description, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp_utc,
    CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 AS is_noise, event_id, user_id, ts, props FROM events)"""

#: The rules that several queries run; k is the events' only nested value.
RULES = [
    {"id": "R1", "title": "error with a high k", "severity": "critical", "attack": ["T1059.001", "T1027"], "scope": {"artifact_type": ["error"]}, "match": [{"field": "raw_data.k", "gt": 90}]},
    {"id": "R2", "title": "purchase or signup by user 1x", "severity": "high", "attack": ["T1204.002"], "match": {"all": [{"field": "artifact_type", "equals_any": ["purchase", "SIGNUP"]}], "any": [{"field": "description", "regex": "user 1\\d$"}, {"field": "raw_data.k", "equals": "7"}]}},
    {"id": "R3", "title": "view, not on host-3", "severity": "low", "match": [{"field": "description", "contains_all": ["VIEW", "user"]}, {"field": "raw_data.k", "lt": 3}], "exclude": [{"field": "host", "equals": "host-3"}]},
    {"id": "R4", "title": "nested alternatives", "severity": "medium", "attack": ["T1105"], "scope": {"artifact_type": ["click", "err"]}, "match": {"any": [{"all": [{"field": "host", "endswith_any": ["-1", "-2"]}, {"any": [{"field": "raw_data.k", "equals": 50}, {"field": "raw_data.k", "equals": "51"}]}]}, {"all": [{"field": "description", "startswith_any": ["click by user 14"]}, {"field": "raw_data.k", "lt": 10}]}]}},
]
#: The same rules in SQL: (id, predicate, matched_on).
_KTEXT = "'raw_data.k=' || k"
RULES_SQL = [
    ("R1", "artifact_type LIKE 'error%' AND k > 90", _KTEXT),
    ("R2", "lower(artifact_type) IN ('purchase', 'signup') AND (regexp_matches(description, 'user 1\\d$') OR k = 7)", "'artifact_type=' || artifact_type || ' | ' || CASE WHEN regexp_matches(description, 'user 1\\d$') THEN 'description=' || description ELSE 'raw_data.k=' || k END"),
    ("R3", "lower(description) LIKE '%view%' AND lower(description) LIKE '%user%' AND k < 3 AND host <> 'host-3'", "'description=' || description || ' | ' || 'raw_data.k=' || k"),
    ("R4", "(artifact_type LIKE 'click%' OR artifact_type LIKE 'err%') AND (((host LIKE '%-1' OR host LIKE '%-2') AND k IN (50, 51)) OR (lower(description) LIKE 'click by user 14%' AND k < 10))", "CASE WHEN (host LIKE '%-1' OR host LIKE '%-2') AND k IN (50, 51) THEN 'host=' || host || ' | raw_data.k=' || k ELSE 'description=' || description || ' | raw_data.k=' || k END"),
]
META = {r["id"]: rules.rule_from(r) for r in RULES}
DET = EV + ", det AS (" + " UNION ALL ".join(f"SELECT artifact_id, case_id, 'rules' AS engine, '{i}' AS rule_id, '{META[i].title}' AS rule_title, '{META[i].severity}' AS severity, {META[i].points} AS score, CAST([{', '.join(repr(a) for a in META[i].attack)}] AS VARCHAR[]) AS attack, {m} AS matched_on, host, timestamp_utc, ts, k, user_id, artifact_type, description, is_noise FROM ev WHERE {p}" for i, p, m in RULES_SQL) + ")"


def _detected(spark: SparkSession, d: str) -> DataFrame:
    return rules.detect(artifacts(spark, d), list(META.values()))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Detections of all rules with host and time, in time order."""
    return store.v_detections(_detected(spark, d), artifacts(spark, d)).select("artifact_id", "case_id", "host", "timestamp_utc", "rule_id", "severity", "score", "matched_on").orderBy("timestamp_utc", "artifact_id", "rule_id")


# --- field operators, one query each -----------------------------------------------------------------------

_OPS = {
    "equals": ({"field": "artifact_type", "equals": "ERROR"}, "lower(artifact_type) = 'error'"),
    "equals_any": ({"field": "raw_data.k", "equals_any": [3, "5", "88"]}, "k IN (3, 5, 88)"),
    "contains": ({"field": "description", "contains": "USER 12"}, "contains(lower(description), 'user 12')"),
    "contains_any": ({"field": "description", "contains_any": ["user 33", "error"]}, "contains(lower(description), 'user 33') OR contains(lower(description), 'error')"),
    "contains_all": ({"field": "description", "contains_all": ["click", "user 1"]}, "contains(lower(description), 'click') AND contains(lower(description), 'user 1')"),
    "startswith_any": ({"field": "description", "startswith_any": ["view by user 9", "Sign"]}, "starts_with(lower(description), 'view by user 9') OR starts_with(lower(description), 'sign')"),
    "endswith_any": ({"field": "host", "endswith_any": ["-4", "-6"]}, "ends_with(host, '-4') OR ends_with(host, '-6')"),
    "regex": ({"field": "description", "regex": "^(Error|View) by user \\d{3}$"}, "regexp_matches(description, '^(Error|View) by user \\d{3}$')"),
    "exists": ({"field": "raw_data.missing", "exists": False}, "json_extract_string(props, '$.missing') IS NULL"),
    "is_true": ({"field": "raw_data.k", "is_true": True}, "k = 1"),
    "gt": ({"field": "raw_data.k", "gt": 95}, "k > 95"),
    "lt": ({"field": "raw_data.k", "lt": 4}, "k < 4"),
}


def _operator_query(condition: dict):
    rule = rules.rule_from({"id": "X", "title": "x", "match": [condition]})
    return lambda spark, d: rules.matches(artifacts(spark, d), [rule], ["artifact_id"]).select("artifact_id")


for _op, (_condition, _sql) in _OPS.items():
    _register(f"op_{_op}", f"WITH {EV} SELECT artifact_id FROM ev WHERE {_sql}")(_operator_query(_condition))


# --- rules ------------------------------------------------------------------------------------------------------

@_register("rule_multi_scan", f"WITH {DET} SELECT artifact_id, rule_id, severity, CAST(score AS INT) AS score, array_to_string(attack, ',') AS attack, matched_on FROM det")
def rule_multi_scan(spark, d):
    return _detected(spark, d).select("artifact_id", "rule_id", "severity", "score", F.array_join("attack", ",").alias("attack"), "matched_on")


def _one_rule(rule_id):
    return lambda spark, d: rules.detect(artifacts(spark, d), [META[rule_id]]).select("artifact_id", "matched_on")


for _id, _name in (("R2", "rule_block_all_any"), ("R3", "rule_exclude"), ("R4", "rule_nested_scope")):
    _register(_name, f"WITH {DET} SELECT artifact_id, matched_on FROM det WHERE rule_id = '{_id}'")(_one_rule(_id))

_register("rule_matched_on_host", f"WITH {DET} SELECT artifact_id, rule_id, matched_on FROM det WHERE host = 'host-2' AND case_id = 'case-a'")(lambda spark, d: rules.detect(artifacts(spark, d), list(META.values()), host="host-2", case_id="case-a").select("artifact_id", "rule_id", "matched_on"))


@_register("rule_coverage", f"""WITH {EV}, told AS (SELECT * FROM (VALUES ('R1', 'error'), ('R4', 'click'), ('R4', 'err'), ('R9', 'memory_'), ('L1', 'auth_log')) v(rule_id, scope)),
met AS (SELECT t.rule_id, t.scope, bool_or(e.artifact_type IS NOT NULL) AS seen FROM told t LEFT JOIN (SELECT DISTINCT artifact_type FROM ev) e ON starts_with(e.artifact_type, t.scope) GROUP BY ALL)
SELECT rule_id, string_agg(scope, ', ' ORDER BY scope) AS scope, CASE WHEN rule_id LIKE 'L%' THEN 'not_applicable' WHEN bool_or(seen) THEN 'runnable' ELSE 'blocked' END AS state FROM met GROUP BY rule_id""")
def rule_coverage(spark, d):
    more = [rules.rule_from({"id": i, "title": "t", "scope": {"artifact_type": [s]}, "match": [{"field": "host", "exists": True}]}) for i, s in (("R9", "memory_"), ("L1", "auth_log"))]
    return rules.coverage([META["R1"], META["R4"], *more], artifacts(spark, d), lambda r: not r.id.startswith("L"))


@_register("rule_unseen_fields", """SELECT 'U1' AS rule_id, 'raw_data.' || v.f AS field FROM (VALUES ('nowhere.deep', '$.nowhere.deep'), ('k', '$.k')) v(f, path) WHERE NOT EXISTS (SELECT 1 FROM events WHERE json_extract(props, v.path) IS NOT NULL)""")
def rule_unseen_fields(spark, d):
    one = rules.rule_from({"id": "U1", "title": "t", "match": [{"field": "raw_data.nowhere.deep", "exists": True}, {"field": "raw_data.k", "exists": True}]})
    return rules.unseen_fields(artifacts(spark, d), [one])


@_register("json_field_histogram", f"WITH {EV} SELECT k, count(*) AS n FROM ev GROUP BY k")
def json_field_histogram(spark, d):
    return artifacts(spark, d).groupBy(rules.field_value("raw_data.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


_SIGMA = {
    "title": "sigma", "id": "s-1", "status": "stable", "level": "high", "logsource": {"product": "demo", "category": "events"}, "tags": ["attack.t1059.001"],
    "detection": {"sel1": {"kind|contains": ["err", "purch"]}, "sel2": {"who|endswith": ["1", "2"]}, "low": {"k": ["1", "2", "3"], "kind": "error"}, "condition": "(1 of sel* and not low) or all of sel*"},
}


@_register("sigma_boolean_condition", f"""WITH {EV}, s AS (SELECT *, contains(artifact_type, 'err') OR contains(artifact_type, 'purch') AS s1, ends_with(description, '1') OR ends_with(description, '2') AS s2, k IN (1, 2, 3) AND artifact_type = 'error' AS low FROM ev)
SELECT artifact_id FROM s WHERE ((s1 OR s2) AND NOT low) OR (s1 AND s2)""")
def sigma_boolean_condition(spark, d):
    rule = sigma.compile_sigma(_SIGMA, {"kind": "artifact_type", "who": "description", "k": "raw_data.k"})
    return sigma.matching(artifacts(spark, d), rule).select("artifact_id")


#: Sigma documents over orders as Sysmon and security events; the last two find nothing: one's log source isn't collected, and no order is a sudo log.
_CORPUS = [
    {"title": "tools by name", "id": "u-1", "level": "high", "tags": ["attack.t1059.001"], "logsource": {"product": "windows", "category": "process_creation"}, "detection": {"a": {"Image|endswith": ["\\p1.exe", "\\p2.exe"]}, "b": {"CommandLine|contains": "urgent"}, "f": {"User": "u3"}, "condition": "(a or b) and not f"}},
    {"title": "dropped files", "id": "u-2", "level": "low", "logsource": {"product": "windows", "category": "file_event"}, "detection": {"s": {"Image|startswith": "C:\\x", "User": ["u1", "u5"]}, "condition": "s"}},
    {"title": "security log", "id": "u-3", "level": "critical", "tags": ["attack.t1070.001"], "logsource": {"product": "windows", "service": "security"}, "detection": {"x1": {"CommandLine|re": "^[12]-"}, "x2": {"User": "u4"}, "condition": "all of x*"}},
    {"title": "no such source", "id": "u-4", "level": "high", "logsource": {"product": "mars", "category": "rover"}, "detection": {"s": {"a": 1}, "condition": "s"}},
    {"title": "encoded", "id": "u-5", "level": "high", "logsource": {"product": "linux", "service": "sudo"}, "detection": {"s": {"a|base64": "x"}, "condition": "s"}},
]


def _logged(spark, d):
    """Orders as event log entries: Sysmon process starts and file events, or the security channel, by the order's number."""
    kind = F.col("o_orderkey") % 4
    payload = F.struct(F.concat(F.lit("C:\\x\\p"), (F.col("o_custkey") % 9).cast("string"), F.lit(".exe")).alias("Image"), F.lower("o_orderpriority").alias("CommandLine"), F.concat(F.lit("u"), (F.col("o_custkey") % 7).cast("string")).alias("User"))
    raw = F.to_json(F.struct(F.when(kind < 2, "1").when(kind == 2, "11").otherwise("4688").alias("EventId"), F.when(kind == 3, "Security").otherwise("Sysmon").alias("Channel"), F.struct(payload.alias("payload")).alias("_enrich")))
    return _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("artifact_id"), F.lit("case-a").alias("case_id"), F.lit("event_log").alias("artifact_type"), raw.alias("raw_data"))


_SAID = "'raw_data._enrich.payload.{0}=' || {1}"
_SIGMA_SQL = r"""WITH l AS (SELECT CAST(o_orderkey AS VARCHAR) AS artifact_id, o_orderkey % 4 AS kind, 'C:\x\p' || (o_custkey % 9) || '.exe' AS image, lower(o_orderpriority) AS line, 'u' || (o_custkey % 7) AS who FROM orders)
SELECT artifact_id, 'tools by name' AS rule_title, 'high' AS severity, 40 AS score, 'T1059.001' AS attack, {all} AS matched_on FROM l WHERE kind < 2 AND (image IN ('C:\x\p1.exe', 'C:\x\p2.exe') OR contains(line, 'urgent')) AND who <> 'u3'
UNION ALL SELECT artifact_id, 'dropped files', 'low', 10, '', {two} FROM l WHERE kind = 2 AND who IN ('u1', 'u5')
UNION ALL SELECT artifact_id, 'security log', 'critical', 70, 'T1070.001', {last} FROM l WHERE kind = 3 AND line[1] IN ('1', '2') AND line[2] = '-' AND who = 'u4'""".format(
    all=" || ' | ' || ".join(_SAID.format(*x) for x in (("Image", "image"), ("CommandLine", "line"), ("User", "who"))), two=" || ' | ' || ".join(_SAID.format(*x) for x in (("Image", "image"), ("User", "who"))), last=" || ' | ' || ".join(_SAID.format(*x) for x in (("CommandLine", "line"), ("User", "who"))))


@_register("sigma_corpus_detect", _SIGMA_SQL)
def sigma_corpus_detect(spark, d):
    """A corpus of Sigma documents in one scan, each in its log source's scope."""
    found, _ = sigma.assemble(_CORPUS)
    return sigma.detect(_logged(spark, d), found).select("artifact_id", "rule_title", "severity", "score", F.array_join("attack", ",").alias("attack"), "matched_on")


@_register("sigma_count_by_window", f"""WITH {EV}, e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM ev WHERE artifact_type = 'error')
SELECT user_id, day, count(*) AS n FROM e GROUP BY user_id, day HAVING count(*) > 2""")
def sigma_count_by_window(spark, d):
    e = _table(spark, d, "events").where(F.col("event_type") == "error").withColumn("at", F.col("ts").cast("timestamp"))
    return sigma.count_over(e, "at", ["user_id"], "1 day", 2).select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


# --- views and timeline -----------------------------------------------------------------------------------------

@_register("v_artifacts", f"WITH {EV} SELECT artifact_id, host, 'kit' AS source, timestamp_utc FROM ev")
def v_artifacts(spark, d):
    evidence = spark.createDataFrame([("s1", "linux", "kit")], "source_id string, os string, tool string")
    return store.v_artifacts(artifacts(spark, d), evidence).select("artifact_id", "host", "source", "timestamp_utc")


_TL = DET + ", tl AS (SELECT e.artifact_id, e.case_id, e.host, e.artifact_type, e.description, e.is_noise, e.timestamp_utc AS ts_utc, coalesce(s.hits, 0) AS hits, coalesce(s.score, 0) AS score FROM ev e LEFT JOIN (SELECT artifact_id, count(*) AS hits, CAST(sum(score) AS BIGINT) AS score FROM det GROUP BY artifact_id) s USING (artifact_id))"


def _timeline(spark, d):
    return store.v_timeline(artifacts(spark, d), _detected(spark, d))


_register("v_timeline", f"WITH {_TL} SELECT artifact_id, ts_utc, hits, score FROM tl")(lambda spark, d: _timeline(spark, d).select("artifact_id", "ts_utc", "hits", "score"))
_register("v_detections", f"WITH {DET} SELECT artifact_id, rule_id, host, artifact_type, timestamp_utc FROM det")(lambda spark, d: store.v_detections(_detected(spark, d), artifacts(spark, d)).select("artifact_id", "rule_id", "host", "artifact_type", "timestamp_utc"))
_register("timeline_flagged", f"WITH {_TL} SELECT artifact_id, ts_utc, description, hits FROM tl WHERE case_id = 'case-a' AND NOT is_noise AND hits > 0 ORDER BY ts_utc")(lambda spark, d: timeline.query(_timeline(spark, d), "case-a", flagged_only=True).select("artifact_id", "ts_utc", "description", "hits"))
_register("timeline_keyword", f"WITH {_TL} SELECT artifact_id, ts_utc FROM tl WHERE case_id = 'case-b' AND NOT is_noise AND description ILIKE '%USER 33%' AND artifact_type LIKE '%ew%' AND ts_utc >= '2024-01-05' AND ts_utc <= '2024-01-25'")(lambda spark, d: timeline.query(_timeline(spark, d), "case-b", start="2024-01-05", end="2024-01-25", artifact_type="ew", keyword="USER 33").select("artifact_id", "ts_utc"))
_register("timeline_pivot", f"WITH {_TL} SELECT artifact_id, ts_utc FROM tl WHERE case_id = 'case-a' AND ts_utc BETWEEN '2024-01-10T11:30:00.000000Z' AND '2024-01-10T12:30:00.000000Z'")(lambda spark, d: timeline.pivot(_timeline(spark, d), "case-a", "2024-01-10T12:00:00Z", 30).select("artifact_id", "ts_utc"))
_register("timeline_first_100", f"WITH {_TL} SELECT artifact_id, ts_utc FROM tl WHERE case_id = 'case-a' AND NOT is_noise ORDER BY ts_utc, artifact_id LIMIT 100")(lambda spark, d: timeline.query(_timeline(spark, d), "case-a", limit=100).select("artifact_id", "ts_utc"))


# --- correlation ------------------------------------------------------------------------------------------------------

@_register("interval_join_first", f"""WITH {EV}, l AS (SELECT * FROM ev WHERE artifact_type = 'purchase'), r AS (SELECT * FROM ev WHERE artifact_type = 'click')
SELECT l.artifact_id, arg_min(r.artifact_id, struct_pack(a := r.ts, b := r.artifact_id)) AS first_click FROM l JOIN r ON l.host = r.host AND r.ts <= l.ts AND l.ts - r.ts <= INTERVAL 60 MINUTE AND r.k > 20 GROUP BY l.artifact_id""")
def interval_join_first(spark, d):
    rows = artifacts(spark, d).select("host", F.to_timestamp("timestamp_utc").alias("ts"), F.col("artifact_id").alias("id"), "artifact_type", rules.field_value("raw_data.k").cast("int").alias("k"))
    met = correlate.interval_first(rows.where("artifact_type = 'purchase'").drop("artifact_type", "k"), rows.where("artifact_type = 'click' and k > 20").drop("artifact_type", "k"), ["host"], 60)
    return met.select(F.col("l.id").alias("artifact_id"), F.col("r.id").alias("first_click"))


def _as_processes(spark, d, kind: str = "memory_process", keep=None):
    """Orders as processes: pid is the order, ppid the customer, the name follows the priority and status."""
    o = _table(spark, d, "orders")
    o = o.where(keep) if keep is not None else o
    name = F.element_at(F.array(*[F.lit(n) for n in ("lsass.exe", "services.exe", "svchost.exe", "wininit.exe", "calc.exe")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    raw = F.to_json(F.struct(F.col("o_orderkey").alias("PID"), F.col("o_custkey").alias("PPID"), name.alias("ImageFileName")))
    return o.select(F.concat(F.lit(f"{kind}-"), F.col("o_orderkey").cast("string")).alias("artifact_id"), F.lit("case-a").alias("case_id"), F.concat(F.lit("h"), (F.col("o_orderkey") % 3).cast("string")).alias("host"), F.lit(kind).alias("artifact_type"), raw.alias("raw_data"))


PR = "pr AS (SELECT 'memory_process-' || o_orderkey AS artifact_id, 'h' || (o_orderkey % 3) AS host, o_orderkey AS pid, o_custkey AS ppid, ['lsass.exe', 'services.exe', 'svchost.exe', 'wininit.exe', 'calc.exe'][CAST(o_orderpriority[1] AS INT)] AS name, o_totalprice FROM orders)"


@_register("anti_join_hidden", f"WITH {PR} SELECT replace(artifact_id, 'process-', 'process_scan-') AS artifact_id FROM pr WHERE o_totalprice >= 400000")
def anti_join_hidden(spark, d):
    both = _as_processes(spark, d, "memory_process", F.col("o_totalprice") < 400000).unionByName(_as_processes(spark, d, "memory_process_scan"))
    return correlate.unlinked_process(both).select("artifact_id")


@_register("singleton_count", f"WITH {PR} SELECT artifact_id, score FROM (SELECT *, count(*) OVER (PARTITION BY host, name) AS n, 80 AS score FROM pr) WHERE name IN ('lsass.exe', 'services.exe', 'wininit.exe') AND n > 1")
def singleton_count(spark, d):
    return correlate.duplicate_singletons(_as_processes(spark, d)).select("artifact_id", "score")


@_register("expected_parent", f"""WITH {PR} SELECT c.artifact_id, c.name || ' pid=' || c.pid || ' started by ' || p.name || ' pid=' || c.ppid AS matched_on FROM pr c JOIN pr p ON p.pid = c.ppid AND p.host = c.host
WHERE (c.name = 'lsass.exe' AND p.name <> 'wininit.exe') OR (c.name = 'services.exe' AND p.name <> 'wininit.exe') OR (c.name = 'svchost.exe' AND p.name <> 'services.exe') OR c.name = 'wininit.exe'""")
def expected_parent(spark, d):
    return correlate.unexpected_parents(_as_processes(spark, d)).select("artifact_id", "matched_on")


@_register("orphan_processes", f"WITH {PR} SELECT artifact_id FROM pr c WHERE ppid NOT IN (0, 1, 4) AND NOT EXISTS (SELECT 1 FROM pr p WHERE p.pid = c.ppid AND p.host = c.host)")
def orphan_processes(spark, d):
    return correlate.orphans(_as_processes(spark, d)).select("artifact_id")


@_register("field_vs_field", """SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS artifact_id, count(*) AS n FROM lineitem WHERE l_discount < l_tax AND l_returnflag = 'R' GROUP BY 1""")
def field_vs_field(spark, d):
    """Two typed fields of one record compared, over every row of lineitem."""
    name = F.concat(*[x for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey") for x in (F.lit("-"), F.col(c).cast("string"))][1:])
    rows = _table(spark, d, "lineitem").where("l_returnflag = 'R'").select(name.alias("artifact_id"), F.lit("case-a").alias("case_id"), F.col("l_discount").alias("new"), F.col("l_tax").alias("old"), F.lit("C:\\x\\PowerShell.exe").alias("image"), F.lit("C:\\x\\a.txt").alias("target"))
    return correlate.moved_back(rows).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"))


@_register("field_vs_field_all", """SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS artifact_id, count(*) AS n FROM lineitem WHERE l_discount < l_tax AND l_returnflag = 'R' GROUP BY 1""")
def field_vs_field_all(spark, d):
    """Two fields of one record compared as texts of its raw data, over every row of lineitem."""
    return _below_tax(_table(spark, d, "lineitem"))


def _sortable(name: str):
    """A finite number as text of one width, in the order of the numbers: all of bigint, fractions to 17 places."""
    return F.lpad((F.col(name).cast("decimal(38,18)") + F.lit(Decimal(10**19))).cast("string"), 38, "0")


def _below_tax(lines):
    """Line items as rewritten creation times, from tax to discount, by a script host; C003 compares the two fields."""
    payload = F.struct(_sortable("l_discount").alias("CreationUtcTime"), _sortable("l_tax").alias("PreviousCreationUtcTime"), F.lit("C:\\x\\PowerShell.exe").alias("Image"), F.lit("C:\\x\\a.txt").alias("TargetFilename"))
    raw = F.to_json(F.struct(F.when(F.col("l_returnflag") == "R", "2").otherwise("1").alias("EventId"), F.lit("Microsoft-Windows-Sysmon/Operational").alias("Channel"), F.struct(payload.alias("payload")).alias("_enrich")))
    name = F.concat(*[x for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey") for x in (F.lit("-"), F.col(c).cast("string"))][1:])
    logs = lines.select(name.alias("artifact_id"), F.lit("case-a").alias("case_id"), F.lit("event_log").alias("artifact_type"), raw.alias("raw_data"))
    return correlate.rewritten_creation_time(logs).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"))


@_register("timestomp_c003", """SELECT 'e' || o_orderkey AS artifact_id, CASE WHEN o_orderkey % 3 = 0 THEN 'script interpreter' ELSE 'protected path' END AS why FROM orders WHERE o_custkey < o_orderkey AND o_orderkey % 3 <> 2""")
def timestomp_c003(spark, d):
    """Creation times moved back, in typed columns, over every order."""
    kind = F.col("o_orderkey") % 3
    image = F.when(kind == 0, "C:\\x\\PowerShell.exe").when(kind == 2, "C:\\x\\Explorer.exe").otherwise("C:\\x\\tool.exe")
    rows = _table(spark, d, "orders").select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("artifact_id"), F.lit("case-a").alias("case_id"), F.col("o_custkey").alias("new"), F.col("o_orderkey").alias("old"), image.alias("image"), F.lit("C:\\Windows\\Temp\\a.txt").alias("target"))
    return correlate.moved_back(rows).select("artifact_id", F.regexp_extract("matched_on", r"\[([^\]]+)\]$", 1).alias("why"))


@_register("timestomp_c003_all", """SELECT 'e' || o_orderkey AS artifact_id, CASE WHEN o_orderkey % 3 = 0 THEN 'script interpreter' ELSE 'protected path' END AS why FROM orders WHERE o_custkey < o_orderkey AND o_orderkey % 3 <> 2""")
def timestomp_c003_all(spark, d):
    """Creation times moved back, as texts of raw data, over every order."""
    return _moved_back(_table(spark, d, "orders"))


def _moved_back(o):
    """Orders as rewritten creation times, from the order to the customer."""
    kind = F.col("o_orderkey") % 3
    payload = F.struct(_sortable("o_custkey").alias("CreationUtcTime"), _sortable("o_orderkey").alias("PreviousCreationUtcTime"), F.when(kind == 0, "C:\\x\\PowerShell.exe").when(kind == 2, "C:\\x\\Explorer.exe").otherwise("C:\\x\\tool.exe").alias("Image"), F.lit("C:\\Windows\\Temp\\a.txt").alias("TargetFilename"))
    raw = F.to_json(F.struct(F.lit("2").alias("EventId"), F.lit("Microsoft-Windows-Sysmon/Operational").alias("Channel"), F.struct(payload.alias("payload")).alias("_enrich")))
    logs = o.select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("artifact_id"), F.lit("case-a").alias("case_id"), F.lit("event_log").alias("artifact_type"), raw.alias("raw_data"))
    return correlate.rewritten_creation_time(logs).select("artifact_id", F.regexp_extract("matched_on", r"\[([^\]]+)\]$", 1).alias("why"))


@_register("service_binary_c008", "SELECT CAST(o_orderkey AS VARCHAR) AS artifact_id, 's' || o_custkey || ': running C:\\x\\p' || (o_custkey % 50) || '.exe but registry says \"C:\\y\\P' || (o_orderkey % 50) || '.EXE\" -k' AS matched_on FROM orders WHERE o_custkey % 50 <> o_orderkey % 50")
def service_binary_c008(spark, d):
    """Orders as services whose running program follows the customer and whose configured one the order."""
    running, configured = F.concat(F.lit("C:\\x\\p"), (F.col("o_custkey") % 50).cast("string"), F.lit(".exe")), F.concat(F.lit('"C:\\y\\P'), (F.col("o_orderkey") % 50).cast("string"), F.lit('.EXE" -k'))
    raw = F.to_json(F.struct(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("Name"), running.alias("Binary"), configured.alias("Binary (Registry)")))
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("artifact_id"), F.lit("case-a").alias("case_id"), F.lit("memory_service").alias("artifact_type"), raw.alias("raw_data"))
    return correlate.service_binary_mismatch(rows).select("artifact_id", "matched_on")


@_register("noise_flag", "SELECT page_id, contains(p, '/proc/') OR contains(p, '/usr/share/doc/') OR contains(p, '/inetcache/') AS is_noise FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/proc/' WHEN 1 THEN '/usr/share/doc/' WHEN 2 THEN '/inetcache/' ELSE '/home/' END || lower(url) AS p FROM pages)")
def noise_flag(spark, d):
    kind = F.col("page_id") % 4
    path = F.concat(F.when(kind == 0, "/proc/").when(kind == 1, "\\usr\\share\\doc\\").when(kind == 2, "\\INetCache\\").otherwise("/home/"), "url")
    return _table(spark, d, "pages").select("page_id", fn.is_noise(path).alias("is_noise"))


def _starts(spark, d):
    """Orders as process starts: the parent of an order's process is the process numbered by its customer."""
    payload = F.struct(F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("ProcessGuid"), F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("ParentProcessGuid"), F.lit("a.exe").alias("Image"), F.lit("a -x").alias("CommandLine"))
    raw = F.to_json(F.struct(F.lit("1").alias("EventId"), F.lit("Sysmon").alias("Channel"), F.struct(payload.alias("payload")).alias("_enrich")))
    return _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("artifact_id"), F.lit("case-a").alias("case_id"), F.lit("event_log").alias("artifact_type"), raw.alias("raw_data"), "o_orderpriority")


@_register("flagged_parent", "SELECT CAST(c.o_orderkey AS VARCHAR) AS artifact_id, 'spawned by a process flagged by ' || substr(p.o_orderpriority, 1, 1) || ': a.exe a -x' AS matched_on FROM orders c JOIN orders p ON p.o_orderkey = c.o_custkey WHERE p.o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flagged_parent(spark, d):
    starts = _starts(spark, d)
    flags = starts.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("artifact_id", F.substring("o_orderpriority", 1, 1).alias("rule_id"), F.lit("high").alias("severity"), F.lit("rules").alias("engine"))
    return correlate.child_of_flagged(starts, flags).select("artifact_id", "matched_on")


@_register("burst_hours", f"WITH {EV} SELECT case_id, host, timestamp_utc[1:13] AS hour, count(*) AS n FROM ev WHERE artifact_type IN ('click', 'view') GROUP BY ALL HAVING count(*) >= 3")
def burst_hours(spark, d):
    runs = artifacts(spark, d).where(F.col("artifact_type").isin("click", "view")).withColumn("artifact_type", F.lit("prefetch_execution"))
    return correlate.execution_bursts(runs, 3)


# --- clusters, techniques, reports ----------------------------------------------------------------------------------------

@_register("cluster_two_level_score", f"""WITH {DET}, sig AS (SELECT case_id, host, CASE WHEN len(attack) > 0 THEN array_to_string(attack, ',') ELSE 'rule:' || rule_id END AS s, max(score) AS score, count(*) AS n, min(timestamp_utc) AS f, max(timestamp_utc) AS l FROM det GROUP BY ALL),
r AS (SELECT case_id, host, count(DISTINCT rule_id) AS rules, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS worst FROM det GROUP BY ALL)
SELECT case_id, host, CAST(sum(score) AS BIGINT) AS score, CAST(sum(n) AS BIGINT) AS hit_count, CAST(any_value(rules) AS INT) AS rule_count, min(f) AS first_seen, max(l) AS last_seen, ['info', 'low', 'medium', 'high', 'critical'][any_value(worst) + 1] AS severity FROM sig JOIN r USING (case_id, host) GROUP BY case_id, host""")
def cluster_two_level_score(spark, d):
    hits = store.v_detections(_detected(spark, d), artifacts(spark, d)).withColumn("ts", F.col("timestamp_utc"))
    return cluster.score_groups(hits, ["case_id", "host"]).select("case_id", "host", F.col("score").cast("long").alias("score"), F.col("hit_count").cast("long").alias("hit_count"), "rule_count", "first_seen", "last_seen", "severity")


_register("techniques", f"WITH {DET} SELECT upper(t) AS technique, count(*) AS hits, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS rules, ['info', 'low', 'medium', 'high', 'critical'][max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) + 1] AS severity, array_to_string(list_sort(list_distinct(list(artifact_id)))[1:20], ',') AS artifacts FROM (SELECT *, unnest(attack) AS t FROM det) GROUP BY 1")(lambda spark, d: attack.techniques(_detected(spark, d)).select("technique", "hits", F.array_join("rules", ",").alias("rules"), "severity", F.array_join("artifacts", ",").alias("artifacts")))
_register("unmapped_rules", f"WITH {DET} SELECT engine, rule_id, severity, count(*) AS n FROM det WHERE len(attack) = 0 GROUP BY ALL")(lambda spark, d: attack.unmapped(_detected(spark, d)))


@_register("tactic_rollup", f"WITH {DET}, m AS (SELECT * FROM (VALUES ('T1059.001', 'execution'), ('T1027', 'defense-evasion'), ('T1204.002', 'execution'), ('T1105', 'command-and-control')) v(technique, tactic)) SELECT tactic, technique, count(*) AS hits FROM (SELECT unnest(attack) AS technique FROM det) JOIN m USING (technique) GROUP BY ALL")
def tactic_rollup(spark, d):
    return attack.tactics(attack.techniques(_detected(spark, d)), attack.pairs_frame(spark, attack.TACTICS, "technique", "tactic")).select("tactic", "technique", "hits")


#: The technique tables in SQL.
def _pairs(table: dict[str, list[str]], key: str, value: str) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, vs in table.items() for v in vs) + f") {key}_{value}({key}, {value})"


_LATE = ", ".join(f"'{t}'" for t in attack.LATE)


@_register("risk_band", f"""WITH {DET}, tac AS (SELECT DISTINCT tactic FROM (SELECT DISTINCT upper(unnest(attack)) AS technique FROM det) JOIN {_pairs(attack.TACTICS, "technique", "tactic")} USING (technique)),
t AS (SELECT CAST(count(*) AS INT) AS n_tactics, CAST(count(*) FILTER (tactic IN ({_LATE})) AS INT) AS n_late FROM tac), c AS (SELECT count(*) AS n_detections, count(*) FILTER (severity = 'critical') AS n_critical FROM det)
SELECT *, CASE WHEN n_detections = 0 THEN 'none' WHEN n_tactics >= 5 AND n_late >= 2 THEN 'critical' WHEN n_tactics >= 4 OR n_late >= 1 THEN 'high' WHEN n_critical > 0 OR n_tactics >= 2 THEN 'medium' ELSE 'low' END AS level FROM t, c""")
def risk_band(spark, d):
    out = attack.risk(_detected(spark, d), attack.pairs_frame(spark, attack.TACTICS, "technique", "tactic"))
    return out.select(F.col("n_tactics").cast("int").alias("n_tactics"), F.col("n_late").cast("int").alias("n_late"), "n_detections", "n_critical", "level")


#: Event types as the evidence that the technique tables know.
_KINDS = {"error": "event_log", "purchase": "memory_network", "click": "mft_file", "view": "prefetch_execution", "signup": "user_account"}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " ELSE event_type END"


def _evidence(spark, d):
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return artifacts(spark, d).withColumn("artifact_type", F.coalesce(kinds[F.col("artifact_type")], F.col("artifact_type")))


_HAVE = f"have AS (SELECT DISTINCT component FROM (SELECT DISTINCT {_KIND_SQL} AS t FROM events) e JOIN {_pairs(attack.PROVIDES, 'prefix', 'component')} ON starts_with(e.t, prefix)), req AS (SELECT * FROM {_pairs(attack.REQUIRES, 'technique', 'component')})"


@_register("relational_division", f"""WITH {_HAVE}, n AS (SELECT technique, CAST(count(*) AS INT) AS needed, CAST(count(*) FILTER (component NOT IN (SELECT component FROM have)) AS INT) AS missing FROM req WHERE technique <> 'T1105' GROUP BY technique)
SELECT technique, needed, missing, CASE WHEN missing = 0 THEN 'gap' ELSE 'partial' END AS state FROM n WHERE missing < needed""")
def relational_division(spark, d):
    have = attack.available(_evidence(spark, d), attack.pairs_frame(spark, attack.PROVIDES, "prefix", "component"))
    named = spark.createDataFrame([("R", "t1105")], "rule_id string, technique string")
    return attack.gaps(attack.pairs_frame(spark, attack.REQUIRES, "technique", "component"), have, named).select("technique", F.col("needed").cast("int").alias("needed"), F.col("missing").cast("int").alias("missing"), "state")


@_register("missing_telemetry", f"""WITH {_HAVE} SELECT v.rule_id, v.technique, string_agg(component, ',' ORDER BY component) AS missing FROM (VALUES ('A', 'T1059.001'), ('A', 'T1105'), ('B', 'T1003.001'), ('B', 'T1071.001')) v(rule_id, technique) JOIN req USING (technique)
WHERE component NOT IN (SELECT component FROM have) GROUP BY ALL""")
def missing_telemetry(spark, d):
    have = attack.available(_evidence(spark, d), attack.pairs_frame(spark, attack.PROVIDES, "prefix", "component"))
    asked = spark.createDataFrame([("A", "T1059.001"), ("A", "T1105"), ("B", "T1003.001"), ("B", "T1071.001")], "rule_id string, technique string")
    return attack.missing_telemetry(attack.pairs_frame(spark, attack.REQUIRES, "technique", "component"), have, asked).select("rule_id", "technique", F.array_join("missing", ",").alias("missing"))


@_register("technique_coverage", f"SELECT DISTINCT technique FROM (SELECT DISTINCT {_KIND_SQL} AS t FROM events) e JOIN {_pairs(attack.COVERAGE, 'prefix', 'technique')} ON starts_with(e.t, prefix)")
def technique_coverage(spark, d):
    return attack.covered(_evidence(spark, d), attack.pairs_frame(spark, attack.COVERAGE, "prefix", "technique"))


_register("prefix_join_coverage", f"WITH {EV} SELECT DISTINCT v.technique FROM ev JOIN (VALUES ('err', 'T1'), ('cl', 'T2'), ('zz', 'T3')) v(prefix, technique) ON starts_with(ev.artifact_type, v.prefix)")(lambda spark, d: attack.covered(artifacts(spark, d), spark.createDataFrame([("err", "T1"), ("cl", "T2"), ("zz", "T3")], "prefix string, technique string")))
_register("compare_cases", f"WITH {DET} SELECT rule_id, count(*) FILTER (case_id = 'case-a') AS n_a, count(*) FILTER (case_id = 'case-b') AS n_b, n_b - n_a AS diff, CASE WHEN n_b > n_a THEN 'more' WHEN n_b < n_a THEN 'fewer' ELSE 'same' END AS change FROM det GROUP BY rule_id")(lambda spark, d: store.compare_cases(_detected(spark, d), "case-a", "case-b").drop("rule_title"))
_register("case_health", f"WITH {EV} SELECT count(*) AS artifacts, array_to_string(list_sort(list_distinct(list(host))), ',') AS hosts, count(*) FILTER (timestamp_utc IS NULL) AS no_time, count(*) FILTER (is_noise) AS noise, min(timestamp_utc) AS first_seen, max(timestamp_utc) AS last_seen FROM ev WHERE case_id = 'case-a'")(lambda spark, d: store.case_health(artifacts(spark, d), "case-a").withColumn("hosts", F.array_join("hosts", ",")))
_register("types_by_count", f"WITH {EV} SELECT artifact_type, count(*) AS n FROM ev WHERE case_id = 'case-b' GROUP BY 1 ORDER BY 2 DESC")(lambda spark, d: store.types_by_count(artifacts(spark, d), "case-b"))


@_register("topk_per_rule", f"WITH {DET} SELECT rule_id, artifact_id, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY timestamp_utc, artifact_id) AS nth FROM det) WHERE nth <= 25")
def topk_per_rule(spark, d):
    from tracelake.operators import report

    return report.top_per_rule(store.v_detections(_detected(spark, d), artifacts(spark, d)), 25).select("rule_id", "artifact_id", "nth")


@_register("findings_by_rule", f"WITH {DET} SELECT rule_id, rule_title, severity, engine, count(*) AS n FROM det GROUP BY ALL")
def findings_by_rule(spark, d):
    from tracelake.operators import report

    return report.findings(_detected(spark, d)).select("rule_id", "rule_title", "severity", "engine", "n")


@_register("report_stats", f"WITH {DET} SELECT count(*) AS detections, count(DISTINCT rule_id) AS rules, min(timestamp_utc) AS first_seen, max(timestamp_utc) AS last_seen FROM det")
def report_stats(spark, d):
    from tracelake.operators import report

    return report.stats(store.v_detections(_detected(spark, d), artifacts(spark, d)))


# --- indicators -----------------------------------------------------------------------------------------------------------

_IPS = "regexp_extract_all(text, '(?:\\d{1,3}\\.){3}\\d{1,3}')"
_IGNORED = " OR ".join(f"starts_with(value, '{p}')" for p in fn.IGNORED_IP)


@_register("ioc_address_extract", f"SELECT doc_id, value FROM (SELECT DISTINCT doc_id, unnest({_IPS}) AS value FROM documents) WHERE NOT ({_IGNORED}) AND list_bool_and(list_transform(string_split(value, '.'), lambda o: CAST(o AS INT) <= 255))")
def ioc_address_extract(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:\d{1,3}\.){3}\d{1,3}"), F.lit(0)))).alias("v"))
    return docs.withColumn("i", fn.classify_indicator(F.col("v"))).where("i.kind = 'ip'").select("doc_id", F.col("i.value").alias("value"))


@_register("url_host_extract", r"SELECT page_id, regexp_extract(lower(url), '://([^/:]*)', 1) AS host FROM pages")
def url_host_extract(spark, d):
    return _table(spark, d, "pages").select("page_id", fn.url_host(F.col("url")).alias("host"))


@_register("ioc_refang_classify", r"SELECT page_id, 'domain' AS kind, regexp_extract(lower(url), '://([^/:]*)', 1) AS value FROM pages")
def ioc_refang_classify(spark, d):
    broken = F.replace(F.replace("url", F.lit("http"), F.lit("hxxp")), F.lit("."), F.lit("[.]"))
    return _table(spark, d, "pages").select("page_id", F.inline(F.array(fn.classify_indicator(broken))))


@_register("ioc_multi_feed_score", r"""WITH p AS (SELECT page_id, regexp_extract(lower(url), '://([^/:]*)', 1) AS value FROM pages), f AS (SELECT value, count(*) AS n FROM (SELECT DISTINCT value, 'feed-a' AS feed FROM p WHERE page_id % 3 = 0 UNION ALL SELECT DISTINCT value, 'feed-b' FROM p WHERE page_id % 2 = 0) GROUP BY value)
SELECT CAST(page_id AS VARCHAR) AS artifact_id, 'IOC-DOMAIN' AS rule_id, CAST(least(60 + 5 * (n - 1), 95) AS INT) AS score FROM p JOIN f USING (value)""")
def ioc_multi_feed_score(spark, d):
    pages = _table(spark, d, "pages")
    visits = pages.select(F.col("page_id").cast("string").alias("artifact_id"), F.lit("case-a").alias("case_id"), F.lit("browser_visit").alias("artifact_type"), F.lit(None).cast("string").alias("timestamp_utc"), F.to_json(F.struct("url")).alias("raw_data"))
    listed = [pages.where(F.col("page_id") % m == 0).select(F.inline(F.array(fn.classify_indicator(F.col("url")))), F.lit(name).alias("feed"), F.lit("2024-01-01").alias("date")) for m, name in ((3, "feed-a"), (2, "feed-b"))]
    return ioc.match(visits, ioc.merge_feeds(listed[0].unionByName(listed[1]))).select("artifact_id", "rule_id", "score")


# --- storage ------------------------------------------------------------------------------------------------------------------

@_register("dedup_key_sha1", "SELECT doc_id, sha1(source || chr(31) || '' || chr(31) || coalesce(lang, '') || chr(31) || '' || chr(31) || text || chr(31) || CAST(n_chars AS VARCHAR)) AS dedup_key FROM documents")
def dedup_key_sha1(spark, d):
    none = F.lit(None).cast("string")
    return _table(spark, d, "documents").select("doc_id", fn.dedup_key(F.col("source"), none, F.col("lang"), none, F.col("text"), F.col("n_chars").cast("string")).alias("dedup_key"))


@_register("first_writer_wins", "SELECT props, event_type, min(event_id) AS event_id FROM events WHERE event_id >= 100 AND (props, event_type) NOT IN (SELECT props, event_type FROM events WHERE event_id < 100) GROUP BY ALL")
def first_writer_wins(spark, d):
    e = _table(spark, d, "events").select("props", "event_type", "event_id")
    return store.insert_new(e.where("event_id < 100"), e.where("event_id >= 100"), ["props", "event_type"], "event_id")


@_register("upsert_coalesce", """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.name, o.name) AS name, CASE WHEN n.c_custkey IS NOT NULL THEN n.seg ELSE o.seg END AS seg
FROM (SELECT c_custkey, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'NEW' END AS seg FROM customer WHERE c_custkey % 4 <> 1) n ON o.c_custkey = n.c_custkey""")
def upsert_coalesce(spark, d):
    c = _table(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    new = c.where("c_custkey % 4 <> 1").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("new "), F.col("c_name"))).alias("name"), F.when(F.col("c_custkey") % 5 != 0, "NEW").alias("seg"))
    return store.upsert(old, new, ["c_custkey"], ("seg",))


@_register("clear_detections", f"WITH {DET} SELECT artifact_id, rule_id FROM det WHERE case_id <> 'case-a'")
def clear_detections(spark, d):
    return store.clear_detections(_detected(spark, d), "case-a", "rules").select("artifact_id", "rule_id")


@_register("manifest_diff", """SELECT coalesce(a.p, b.p) AS path, CASE WHEN b.p IS NULL THEN 'missing' WHEN a.p IS NULL THEN 'added' ELSE 'changed' END AS state FROM (SELECT CAST(o_orderkey AS VARCHAR) AS p, o_orderstatus AS h FROM orders WHERE o_orderkey % 5 <> 0) a
FULL JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS p, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 11 <> 0) b ON a.p = b.p WHERE a.p IS NULL OR b.p IS NULL OR a.h <> b.h""")
def manifest_diff(spark, d):
    from tracelake.sources import manifest

    o = _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("sha256"), "o_orderkey")
    kept = o.where("o_orderkey % 5 <> 0").select("path", "sha256")
    found = o.where("o_orderkey % 11 <> 0").select("path", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("sha256")).alias("sha256"))
    return manifest.compare(kept, found)


@_register("except_covered_detected", f"WITH {DET} SELECT DISTINCT artifact_type FROM ev EXCEPT SELECT artifact_type FROM det")
def except_covered_detected(spark, d):
    a = artifacts(spark, d)
    return a.select("artifact_type").distinct().join(store.v_detections(_detected(spark, d), a).select("artifact_type"), "artifact_type", "left_anti")


@_register("timestamp_normalize", """SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 2100 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000000Z') END AS ts FROM orders""")
def timestamp_normalize(spark, d):
    """Order dates written in several notations come back as one canonical text."""
    o = _table(spark, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS'0'")).when(k == 1, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.date_format("t", "yyyy-MM-dd")).otherwise(F.concat(F.date_format(F.col("t") + F.expr("INTERVAL 90 MINUTE"), "yyyy-MM-dd HH:mm:ss"), F.lit("+0130")))
    return o.select("o_orderkey", fn.normalize_timestamp(text).alias("ts"))


@_register("rule_noise_report", f"WITH {EV} SELECT 'R3' AS rule_id, count(*) FILTER (lower(description) LIKE '%view%' AND k < 3) AS matched, count(*) FILTER (lower(description) LIKE '%view%' AND k < 3 AND host = 'host-3') AS excluded, count(*) AS seen FROM ev")
def rule_noise_report(spark, d):
    from tracelake.operators import report

    return report.rule_noise(artifacts(spark, d), [META["R3"]])


#: (rule, nth, part, holds, matched, without) of every condition of R2 to R4 in SQL: the rule as it is, and without the condition.
def _noise_sql() -> str:
    view, low_k, host3 = "contains(lower(description), 'view') AND contains(lower(description), 'user')", "coalesce(k < 3, false)", "host = 'host-3'"
    kind, user1, seven = "lower(artifact_type) IN ('purchase', 'signup')", "regexp_matches(description, 'user 1\\d$')", "coalesce(k = 7, false)"
    ends, fifty, fifty1, click14, low10 = "(host LIKE '%-1' OR host LIKE '%-2')", "coalesce(k = 50, false)", "coalesce(k = 51, false)", "starts_with(lower(description), 'click by user 14')", "coalesce(k < 10, false)"
    told = [
        ("R2", 0, "match", kind, f"({user1} OR {seven})"), ("R2", 1, "match", user1, f"({kind} AND {seven})"), ("R2", 2, "match", seven, f"({kind} AND {user1})"),
        ("R3", 0, "match", view, f"({low_k} AND NOT {host3})"), ("R3", 1, "match", low_k, f"({view} AND NOT {host3})"), ("R3", 2, "exclude", host3, f"({view} AND {low_k})"),
        ("R4", 0, "match", ends, f"(({fifty} OR {fifty1}) OR ({click14} AND {low10}))"), ("R4", 1, "match", fifty, f"(({ends} AND {fifty1}) OR ({click14} AND {low10}))"), ("R4", 2, "match", fifty1, f"(({ends} AND {fifty}) OR ({click14} AND {low10}))"),
        ("R4", 3, "match", click14, f"(({ends} AND ({fifty} OR {fifty1})) OR {low10})"), ("R4", 4, "match", low10, f"(({ends} AND ({fifty} OR {fifty1})) OR {click14})"),
    ]
    whole = {"R2": f"({kind} AND ({user1} OR {seven}))", "R3": f"({view} AND {low_k} AND NOT {host3})", "R4": f"(({ends} AND ({fifty} OR {fifty1})) OR ({click14} AND {low10}))"}
    scope = {"R2": "true", "R3": "true", "R4": "(artifact_type LIKE 'click%' OR artifact_type LIKE 'err%')"}
    field = {"k": "k IS NOT NULL"}
    return " UNION ALL ".join(f"SELECT '{r}' AS rule_id, {n} AS nth, '{part}' AS part, count(*) FILTER ({test}) AS holds, count(*) FILTER ({field['k'] if test.startswith('coalesce(k') else 'true'}) AS filled, count(*) AS seen, count(*) FILTER ({whole[r]}) AS matched, count(*) FILTER ({without}) AS without FROM ev WHERE {scope[r]}" for r, n, part, test, without in told)


@_register("rule_noise_conditions", f"WITH {EV} {_noise_sql()}")
def rule_noise_conditions(spark, d):
    """What each condition of a rule takes, and what the rule would without it."""
    from tracelake.operators import noise

    return noise.conditions(artifacts(spark, d), [META[r] for r in ("R2", "R3", "R4")]).drop("condition")


from tracelake import catalog_summary  # noqa: E402, F401  # registers its queries, which stand on those above
