"""What a case comes to: the chain of techniques, what to do next, what was not looked at, and how a simulated attack fared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import severity_rank
from tracelake.operators import cluster
from tracelake.operators.attack import LATE, TACTIC_ORDER
from tracelake.plans.rules import Rule, in_scope


def outcomes(artifacts: DataFrame, which: list[Rule], detections: DataFrame) -> DataFrame:
    """(rule_id, scanned, hits, outcome) of each rule.

    ``scanned`` counts the artifacts in its scope. Without any the outcome is `nothing_to_scan`, a gap
    of the collection; with some it is `fired` or `unfired`, which is a result. One aggregation by
    type; the rules then meet a row a type.
    """
    types = artifacts.groupBy("artifact_type").agg(F.count(F.lit(1)).alias("n"))
    counts = [F.struct(F.lit(r.id).alias("rule_id"), F.coalesce(F.sum(F.when(in_scope(r, F.col("artifact_type")), F.col("n"))), F.lit(0)).alias("scanned")) for r in which]
    seen = types.agg(F.array(*counts).alias("all")).select(F.inline("all"))
    out = seen.join(detections.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits")), "rule_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("outcome", F.when(F.col("scanned") == 0, "nothing_to_scan").when(F.col("hits") > 0, "fired").otherwise("unfired"))


def chain(v_detections: DataFrame, tactic_of: DataFrame) -> DataFrame:
    """Techniques that were seen, by stage of the attack and then by first time; a technique counts in each of its tactics.

    A detection counts once for a technique that its rule names twice. Techniques without a tactic aren't part of the chain.
    """
    named = F.array_distinct(F.transform(F.coalesce("attack", F.array().cast("array<string>")), lambda t: F.upper(F.trim(t))))
    one = v_detections.withColumn("technique", F.explode(named)).where("technique <> ''")
    by = one.groupBy("technique").agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_set("rule_id")).alias("rules"), F.min("timestamp_utc").alias("first_seen"), F.max("timestamp_utc").alias("last_seen"))
    stage = F.array_position(F.array(*[F.lit(t) for t in TACTIC_ORDER]), F.col("tactic")).cast("int")
    placed = by.join(tactic_of, "technique").withColumns({"stage": stage, "late": F.col("tactic").isin(LATE)}).where("stage > 0")
    return placed.select("stage", "tactic", "late", "technique", "hits", "rules", "first_seen", "last_seen").orderBy("stage", F.col("first_seen").asc_nulls_last(), "technique")


def triage_queue(detections: DataFrame, artifacts: DataFrame, k: int = 10, least_rules: int = 2) -> DataFrame:
    """The ``k`` processes with the highest scores among those that at least so many rules flag: a ranking, not a verdict."""
    found = cluster.clusters(detections, artifacts, least_rules)
    return found.orderBy(F.desc("score"), F.desc("rule_count"), "case_id", "host", "key").limit(k)


def actions(detections: DataFrame, advice: DataFrame) -> DataFrame:
    """Advice (rule_id, action, because) for the rules that fired, the worst severity first."""
    fired = detections.groupBy("rule_id").agg(F.max(severity_rank(F.col("severity"))).alias("rank"), F.count(F.lit(1)).alias("hits"))
    return fired.join(advice, "rule_id").orderBy(F.desc("rank"), F.desc("hits"), "rule_id").drop("rank")


def wanted_types(coverage: DataFrame) -> DataFrame:
    """(artifact_type, rules_blocked): types that the blocked rules of rules.coverage() wait for, the most wanted first."""
    blocked = coverage.where(F.col("state") == "blocked").select(F.explode(F.split("scope", ", ")).alias("artifact_type"))
    return blocked.groupBy("artifact_type").agg(F.count(F.lit(1)).alias("rules_blocked")).orderBy(F.desc("rules_blocked"), "artifact_type")


def unplaced_techniques(which: list[Rule], tactic_of: DataFrame) -> DataFrame:
    """Techniques that rules name and no tactic has: they would be missing from the chain."""
    spark = tactic_of.sparkSession
    named = spark.createDataFrame([(t.upper(), r.id) for r in which for t in r.attack], "technique string, rule_id string")
    return named.join(tactic_of, "technique", "left_anti").groupBy("technique").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


@dataclass(frozen=True)
class Action:
    """A step of a simulated attack: what it leaves behind (``marker``) and the rules that should fire."""

    technique: str
    marker: str = ""
    expected: tuple[str, ...] = ()
    done: bool = True


def score_simulation(v_detections: DataFrame, steps: list[Action]) -> DataFrame:
    """(step, technique, state, fired, by) of each step.

    A step is `detected` if a detection's artifact mentions its marker (by `marker`) or else an
    expected rule fired at all (by `rule`), `missed` if neither, `skipped` if it was not done.
    ``v_detections`` has rule_id, description and raw_data. All steps share one scan: each is a
    conditional aggregate of at most as many values as there are rules.
    """
    text = F.lower(F.concat_ws("\n", "description", "raw_data"))

    def rules_where(test: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(test, F.col("rule_id"))))

    parts = []
    for i, s in enumerate(steps):
        marked = rules_where(text.contains(s.marker.lower()) if s.marker else F.lit(False))
        asked = rules_where(F.col("rule_id").isin(*s.expected) if s.expected else F.lit(False))
        parts.append(F.struct(F.lit(i).alias("step"), F.lit(s.technique).alias("technique"), F.lit(s.done).alias("done"), marked.alias("marked"), asked.alias("asked")))
    if not parts:
        return v_detections.sparkSession.createDataFrame([], "step int, technique string, state string, fired array<string>, by string")
    out = v_detections.agg(F.array(*parts).alias("all")).select(F.inline("all"))
    fired = F.array_sort(F.array_union("marked", "asked"))
    state = F.when(~F.col("done"), "skipped").when(F.size(fired) > 0, "detected").otherwise("missed")
    by = F.when(~F.col("done"), "").when(F.size("marked") > 0, "marker").when(F.size("asked") > 0, "rule").otherwise("")
    return out.select("step", "technique", state.alias("state"), F.when(F.col("done"), fired).otherwise(F.array().cast("array<string>")).alias("fired"), by.alias("by"))


def simulation_rate(scored: DataFrame) -> DataFrame:
    """One row: steps that were done, detected and missed."""
    return scored.agg(F.count_if(F.col("state") != "skipped").alias("done"), F.count_if(F.col("state") == "detected").alias("detected"), F.count_if(F.col("state") == "missed").alias("missed"))
