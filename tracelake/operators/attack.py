"""Technique and tactic rollups, coverage, and detection gaps."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import severity_of_rank, severity_rank
from tracelake.operators.attack_tables import COVERAGE, PROVIDES, REQUIRES, SYSMON_PROVIDES, TACTICS  # noqa: F401 the tables that pairs_frame() makes frames of

TACTIC_ORDER = ["reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion", "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact"]
LATE = ["credential-access", "lateral-movement", "collection", "exfiltration", "impact", "command-and-control"]
COLOURS = {"critical": "#a32020", "high": "#d1601a", "medium": "#e8b53a", "low": "#8fb04a", "info": "#8fb04a"}


def pairs_frame(spark: SparkSession, table: dict[str, list[str]], key: str, value: str) -> DataFrame:
    """A mapping to lists as a table of pairs."""
    return spark.createDataFrame([(k, v) for k, vs in table.items() for v in vs], f"{key} string, {value} string")


def techniques(detections: DataFrame) -> DataFrame:
    """Each technique of detections that fired: hits, rules, engines, worst severity, 20 artifacts at most."""
    one = detections.withColumn("technique", F.explode("attack")).withColumn("technique", F.upper(F.trim("technique"))).where("technique <> ''")
    # ranked before they are gathered: however often a technique fires, a task holds 20 of its artifacts
    named = one.where(F.col("artifact_id").isNotNull()).select("technique", "artifact_id").distinct()
    first = named.withColumn("nth", F.row_number().over(Window.partitionBy("technique").orderBy("artifact_id"))).where("nth <= 20")
    first = first.groupBy("technique").agg(F.array_sort(F.collect_list("artifact_id")).alias("artifacts"))
    out = one.groupBy("technique").agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_set("rule_id")).alias("rules"), F.array_sort(F.collect_set("engine")).alias("engines"), F.max(severity_rank(F.col("severity"))).alias("rank"))
    out = out.join(first, "technique", "left").withColumn("artifacts", F.coalesce("artifacts", F.array().cast("array<string>")))
    return out.withColumn("severity", severity_of_rank(F.greatest("rank", F.lit(0)))).drop("rank")


def unmapped(detections: DataFrame) -> DataFrame:
    """Rules that fired and name no technique."""
    return detections.where(F.coalesce(F.size("attack"), F.lit(0)) < 1).groupBy("engine", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id")


def tactics(found: DataFrame, tactic_of: DataFrame) -> DataFrame:
    """Technique rollup by tactic; a technique counts in each of its tactics, one without any in `unknown`."""
    return found.join(tactic_of, "technique", "left").withColumn("tactic", F.coalesce("tactic", F.lit("unknown"))).orderBy("tactic", F.desc("hits"), "technique")


def covered(artifacts: DataFrame, coverage: DataFrame) -> DataFrame:
    """Techniques that the collected artifact types could have shown; coverage has prefix and technique."""
    types = artifacts.select("artifact_type").distinct()
    return types.join(coverage, F.col("artifact_type").startswith(F.col("prefix"))).select("technique").distinct()


def coverage_report(detections: DataFrame, artifacts: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: techniques detected, examined and clean, and detections and rules without a technique."""
    found, none = techniques(detections).select("technique"), unmapped(detections)
    clean = covered(artifacts, coverage).join(found, "technique", "left_anti")
    return found.agg(F.count(F.lit(1)).alias("detected")).join(clean.agg(F.count(F.lit(1)).alias("examined_clean"))).join(none.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unmapped_detections"), F.count(F.lit(1)).alias("unmapped_rules")))


def available(artifacts: DataFrame, provides: DataFrame, sysmon_provides: list[str] = ()) -> DataFrame:
    """(component, sources): telemetry that is present and the artifact types that supply it."""
    types = artifacts.select("artifact_type").distinct()
    told = types.join(provides, F.col("artifact_type").startswith(F.col("prefix"))).select("component", "artifact_type")
    if sysmon_provides:
        channel = F.lower(F.coalesce(F.try_variant_get(F.try_parse_json("raw_data"), "$.Channel", "string"), F.lit("")))
        sysmon = artifacts.where((F.col("artifact_type") == "event_log") & channel.contains("sysmon")).limit(1)
        told = told.unionByName(sysmon.select(F.explode(F.array(*[F.lit(c) for c in sysmon_provides])).alias("component"), F.lit("event_log (Sysmon)").alias("artifact_type")))
    return told.groupBy("component").agg(F.array_sort(F.collect_set("artifact_type")).alias("sources"))


def gaps(requires: DataFrame, have: DataFrame, rule_techniques: DataFrame) -> DataFrame:
    """Techniques without a rule: `gap` if every required component is present, `partial` if some are.

    Relational division: requires has technique and component; an absent component leaves a null.
    """
    open_ones = requires.join(rule_techniques.select(F.upper("technique").alias("technique")).distinct(), "technique", "left_anti")
    by = open_ones.join(have.select("component", F.lit(True).alias("there")), "component", "left").groupBy("technique").agg(F.count(F.lit(1)).alias("needed"), F.count_if(F.col("there").isNull()).alias("missing"))
    return by.where("missing < needed").withColumn("state", F.when(F.col("missing") == 0, "gap").otherwise("partial"))


def missing_telemetry(requires: DataFrame, have: DataFrame, rule_techniques: DataFrame) -> DataFrame:
    """(rule_id, technique, missing): rules whose technique needs telemetry that isn't there."""
    asked = rule_techniques.select("rule_id", F.upper("technique").alias("technique")).join(requires, "technique")
    return asked.join(have, "component", "left_anti").groupBy("rule_id", "technique").agg(F.array_sort(F.collect_set("component")).alias("missing"))


def navigator_layer(detections: DataFrame, artifacts: DataFrame, coverage: DataFrame, path: str, name: str) -> dict:
    """Writes an ATT&CK Navigator layer: detected techniques scored by hits, examined and clean ones in grey."""
    found = techniques(detections).orderBy("technique").collect()  # at most as many rows as techniques
    seen = {r["technique"] for r in found}
    shown = [{"techniqueID": r["technique"], "score": r["hits"], "enabled": True, "color": COLOURS[r["severity"]], "comment": f"{'; '.join(r['rules'])[:300]} | engines: {', '.join(r['engines'])}"} for r in found]
    shown += [{"techniqueID": r["technique"], "score": 0, "enabled": True, "color": "#3a3f4a", "comment": "artifact type collected; no detection fired"} for r in covered(artifacts, coverage).orderBy("technique").collect() if r["technique"] not in seen]
    layer = {"name": name, "domain": "enterprise-attack", "versions": {"attack": "17", "navigator": "4.9", "layer": "4.5"}, "sorting": 3, "hideDisabled": False, "techniques": shown}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(layer, indent=2), encoding="utf-8")
    return layer


def risk(detections: DataFrame, tactic_of: DataFrame) -> DataFrame:
    """One row: risk level by how many tactics were seen and how many of them are late ones, never by volume."""
    one = detections.select(F.explode_outer("attack").alias("technique")).select(F.upper("technique").alias("technique")).distinct()
    seen = one.join(tactic_of, "technique").select("tactic").distinct().where(F.col("tactic").isin(TACTIC_ORDER))
    n = seen.agg(F.count(F.lit(1)).alias("n_tactics"), F.count_if(F.col("tactic").isin(LATE)).alias("n_late"))
    crit = detections.agg(F.count(F.lit(1)).alias("n_detections"), F.count_if(F.col("severity") == "critical").alias("n_critical"))
    t, late = F.col("n_tactics"), F.col("n_late")
    level = F.when(F.col("n_detections") == 0, "none").when((t >= 5) & (late >= 2), "critical").when((t >= 4) | (late >= 1), "high").when((F.col("n_critical") > 0) | (t >= 2), "medium").otherwise("low")
    return n.join(crit).withColumn("level", level)
