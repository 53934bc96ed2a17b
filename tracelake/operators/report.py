"""Aggregates behind the report, the risk summary, and the report page itself."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import severity_rank
from tracelake.operators import attack, cluster, ioc, store, summary
from tracelake.plans import rules


def findings(detections: DataFrame) -> DataFrame:
    """Hits by rule, worst severity first."""
    by = detections.groupBy("rule_id", "rule_title", "severity", "engine").agg(F.count(F.lit(1)).alias("n"))
    return by.orderBy(severity_rank(F.col("severity")).desc(), F.desc("n"), "rule_id")


def top_per_rule(v_detections: DataFrame, k: int = 25) -> DataFrame:
    """The first k detections of each rule, by time; nth counts from 1."""
    order = Window.partitionBy("rule_id").orderBy(F.col("timestamp_utc").asc_nulls_last(), "artifact_id")
    return v_detections.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def alerts(v_detections: DataFrame) -> DataFrame:
    """Critical rules: hits, first and last time."""
    return v_detections.where(F.col("severity") == "critical").groupBy("rule_id", "rule_title").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_utc").alias("first_seen"), F.max("timestamp_utc").alias("last_seen")).orderBy(F.desc("n"), "rule_id")


def stats(v_detections: DataFrame) -> DataFrame:
    return v_detections.agg(F.count(F.lit(1)).alias("detections"), F.count_distinct("rule_id").alias("rules"), F.min("timestamp_utc").alias("first_seen"), F.max("timestamp_utc").alias("last_seen"))


def blocked_by_types(coverage: DataFrame) -> DataFrame:
    """Blocked rules by the set of types they wait for."""
    return coverage.where(F.col("state") == "blocked").groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("rule_id")).alias("rules")).orderBy(F.desc("n"), "scope")


def rule_noise(artifacts: DataFrame, which: list[rules.Rule]) -> DataFrame:
    """rule_id, rows its match block takes, rows of those that exclude drops, rows in scope: one conditional aggregation."""
    fields = rules.Fields(n for r in which for n in rules.fields_of(r))
    one = []
    for r in which:
        scope = rules.in_scope(r, F.col("artifact_type"))
        test = rules.compile_block(r.match, fields)[0]
        out = rules.any_of([rules.compile_block(x, fields)[0] for x in r.exclude])
        one.append(F.struct(F.lit(r.id).alias("rule_id"), F.count_if(scope & test).alias("matched"), F.count_if(scope & test & out).alias("excluded"), F.count_if(scope).alias("seen")))
    return fields.project(artifacts).agg(F.array(*one).alias("all")).select(F.inline("all"))


def _rows(df: DataFrame, most: int) -> str:
    """A table of the first ``most`` rows; of longer ones it says how many rows there are."""
    cell = lambda v: html.escape(", ".join(map(str, v)) if isinstance(v, list) else "" if v is None else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    shown = df.limit(most + 1).collect()
    told = f"<p>{most} of {df.count()} rows are shown.</p>" if len(shown) > most else ""
    return f"{told}<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in shown[:most]) + "</table>"


def write_report(path: str, title: str, sections: dict[str, DataFrame], most: int = 500) -> None:
    """One page with a table for each section; at most ``most`` rows of each reach the driver, and a longer section says how many it has."""
    body = "".join(f"<h2>{html.escape(name)}</h2>{_rows(df, most)}" for name, df in sections.items())
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}', encoding="utf-8")


def case_sections(case_id: str, artifacts: DataFrame, detections: DataFrame, evidence: DataFrame, which: list[rules.Rule], rulesets: DataFrame | None = None) -> dict[str, DataFrame]:
    """The sections of a case's report by name, in order. Each is an aggregate, a ranking or a first part of the timeline."""
    spark = artifacts.sparkSession
    mine, found = (df.where(F.col("case_id") == case_id) for df in (artifacts, detections))
    seen = store.v_detections(found, mine)
    tactic_of = attack.pairs_frame(spark, attack.TACTICS, "technique", "tactic")
    sections = {
        "Case": store.case_health(artifacts, case_id),
        "Risk": attack.risk(found, tactic_of),
        "Alerts": alerts(seen),
        "Triage queue": summary.triage_queue(found, mine).select("score", "rule_count", "pid", "names", "severity"),
        "Evidence": evidence.where(F.col("case_id") == case_id).select("host", "tool", "source_path", "sha256", "size_bytes", "acquired_utc", "status"),
        "Scope": rules.coverage(which, mine) if which else None,
        "Outcomes": summary.outcomes(mine, which, found) if which else None,
        "Rulesets": rulesets,
        "Process clusters": cluster.clusters(found, mine, 2).limit(15),
        "Indicators": ioc.summary(found, mine).select("rule_id", "severity", "score", "timestamp_utc", "host", "matched_on"),
        "Findings": findings(found),
        "First hits of each rule": top_per_rule(seen, 25).select("rule_id", "timestamp_utc", "host", "description", "matched_on").orderBy("rule_id", F.col("timestamp_utc").asc_nulls_last()),
        "Attack chain": summary.chain(seen, tactic_of),
        "Techniques": attack.techniques(found).drop("artifacts").orderBy(F.desc("hits"), "technique"),
        "Coverage": attack.coverage_report(found, mine, attack.pairs_frame(spark, attack.COVERAGE, "prefix", "technique")),
        "Timeline of detections": seen.select("timestamp_utc", "host", "artifact_type", "rule_id", "severity", "description").orderBy(F.col("timestamp_utc").asc_nulls_last(), "rule_id"),
        "Artifact types": store.types_by_count(artifacts, case_id),
    }
    return {name: df for name, df in sections.items() if df is not None}
