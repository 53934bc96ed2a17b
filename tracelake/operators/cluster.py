"""Detections grouped by the process they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import first_filled, severity_of_rank, severity_rank

#: Artifact types that carry a process id of their own.
PID_TYPES = ["memory_process", "memory_cmdline", "memory_network", "memory_injection", "memory_yara_hit", "memory_environment", "memory_shell_history", "memory_loaded_library", "memory_open_file", "memory_process_spoof"]


def _key(*parts: str) -> Column:
    return F.coalesce(F.try_variant_get("v__", "$" + "".join(f"['{p}']" for p in parts), "string"), F.lit(""))


def identity(artifact_type: Column) -> Column:
    """struct(key, pid, name, has_guid) of the process an artifact belongs to, from the variant column v__; null if none."""
    pay = lambda k: _key("_enrich", "payload", k)
    guid, pid = first_filled(pay("ProcessGuid"), pay("SourceProcessGuid")), first_filled(pay("ProcessId"), pay("SourceProcessId"))
    image = first_filled(pay("Image"), pay("SourceImage"))
    memory_pid, live_pid = first_filled(_key("PID"), _key("pid")), _key("pid")
    memory = F.lit(False)
    for t in PID_TYPES:
        memory = memory | artifact_type.startswith(t)
    made = lambda kind, value, p, name, has: F.struct(F.concat(F.lit(kind), value).alias("key"), p.alias("pid"), name.alias("name"), F.lit(has).alias("has_guid"))
    return (
        F.when(guid != "", made("guid:", guid, F.coalesce(F.nullif(pid, F.lit("")), F.lit("?")), image, True))
        .when(pid != "", made("pid:", pid, pid, image, False))
        .when(memory & (memory_pid != ""), made("pid:", memory_pid, memory_pid, first_filled(_key("ImageFileName"), _key("COMM"), _key("Process"), _key("Name")), False))
        .when((artifact_type == "process") & (live_pid != ""), made("pid:", live_pid, live_pid, F.substring(_key("command"), 1, 60), False))
    )


def score_groups(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of groups of hits: the highest score of each signal counts once, and signals add up.

    ``hits`` has the keys, rule_id, severity, score, attack and ts. A signal is a set of
    techniques, or the rule itself if it names none. Two partial aggregations.
    """
    signal = F.when(F.size("attack") > 0, F.array_join(F.transform("attack", F.upper), ",")).otherwise(F.concat(F.lit("rule:"), F.col("rule_id")))
    by_signal = hits.groupBy(*keys, signal.alias("signal")).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("hits"), F.collect_set("rule_id").alias("rules"), F.flatten(F.collect_set(F.transform("attack", F.upper))).alias("attack"), F.max(severity_rank(F.col("severity"))).alias("rank"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    rules = F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules"))))
    out = by_signal.groupBy(*keys).agg(F.sum("score").alias("score"), F.sum("hits").alias("hit_count"), rules.alias("rules"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("attack")))).alias("attack"), F.max("rank").alias("rank"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return out.withColumns({"rule_count": F.size("rules"), "severity": F.coalesce(F.when(F.col("rank") >= 0, severity_of_rank(F.greatest("rank", F.lit(0)))), F.lit("info"))}).drop("rank")


def clusters(detections: DataFrame, artifacts: DataFrame, least_rules: int = 1, host: str | None = None) -> DataFrame:
    """Process clusters of each case, highest score first; processes are told apart by GUID or else by id (and host)."""
    told = artifacts.where(F.col("host") == host) if host else artifacts
    told = told.withColumn("v__", F.try_parse_json("raw_data")).select("artifact_id", "host", F.col("timestamp_utc").alias("ts"), identity(F.col("artifact_type")).alias("p"))
    hits = detections.join(told, "artifact_id").where("p is not null").withColumns({"key": F.col("p.key"), "name": F.col("p.name")})
    keys = ["case_id", "host", "key"]
    names = hits.groupBy(*keys).agg(F.array_sort(F.collect_set(F.nullif("name", F.lit("")))).alias("names"), F.min("p.pid").alias("pid"), F.max("p.has_guid").alias("has_guid"))
    out = score_groups(hits, keys).join(names, keys).where(F.col("rule_count") >= least_rules)
    return out.withColumn("names", F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("(unknown)")))).orderBy(F.desc("score"), F.desc("rule_count"), "key")


def coverage(detections: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row: detections that belong to a process, that don't, and clusters with two rules or more."""
    told = artifacts.withColumn("v__", F.try_parse_json("raw_data")).select("artifact_id", "host", identity(F.col("artifact_type"))["key"].alias("key"))
    hits = detections.join(told, "artifact_id")
    by = hits.where("key is not null").groupBy("case_id", "host", "key").agg(F.count_distinct("rule_id").alias("n"))
    many = by.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") >= 2).alias("multi_rule"))
    return hits.agg(F.count_if(F.col("key").isNotNull()).alias("clustered"), F.count_if(F.col("key").isNull()).alias("unclustered")).join(many)
