"""Commands over a folder of tables: ``python -m tracelake --store FOLDER COMMAND --case CASE``.

Every command is a few calls of the library; results are shown or written by Spark. The session
is the caller's own under spark-submit, else a local one.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import session
from tracelake.operators import attack, cluster, correlate, ioc, report, store, summary, timeline
from tracelake.plans import rules, sigma
from tracelake.sources import containers, linux_text, tabular, yara


def init(spark: SparkSession, tables: store.Store, a: argparse.Namespace) -> None:
    """Makes the store's tables where there are none."""
    tables.init()


def _register(spark: SparkSession, tables: store.Store, case: str, host: str, path: str, tool: str) -> str:
    """The source_id of a source that is registered as evidence of the case."""
    given = spark.createDataFrame([(case, host, path, tool, "ok")], "case_id string, host string, source_path string, tool string, status string")
    fresh = given.select(*[(F.col(f.name) if f.name in given.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in store.model.EVIDENCE])
    tables.rewrite_evidence(store.register_evidence(tables.read("evidence"), fresh))
    at = (F.col("case_id") == case) & (F.col("host") == host) & (F.col("source_path") == path)
    return tables.read("evidence").where(at).first()["source_id"]


def ingest(spark: SparkSession, tables: store.Store, a: argparse.Namespace) -> None:
    """Parses exported tables, memory results, browser databases or an extracted collection, and registers the folder as a source of the case."""
    source_id = _register(spark, tables, a.case, a.host, a.path, a.kind)
    if a.kind == "tables":
        found = tabular.ingest_csv_folder(spark, a.path, a.case, a.host, source_id, a.include_mft)
    elif a.kind == "memory":
        paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(a.path).select("path")
        plugins = {r["path"].rsplit("/", 1)[1].removesuffix(".json"): r["path"] for r in paths.collect()}  # a file for each plugin
        found = tabular.ingest_memory(spark, plugins, a.case, a.host, source_id, a.acquired)
    elif a.kind == "browsers":
        found = containers.ingest_browsers(spark, a.path, a.case, a.host, source_id)
    else:
        found, unknown = linux_text.ingest_collection(spark, a.path, a.case, a.host, source_id)
        print(f"{len(unknown)} files that no parser knows")
    tables.put_source(a.case, source_id, found)
    stats(spark, tables, a)


def _scan(spark: SparkSession, tables: store.Store, a: argparse.Namespace) -> DataFrame:
    """Stores the files that YARA rules match as artifacts; returns their detections."""
    text = "\n".join(r["value"] for r in spark.read.text(a.yara, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yar,yara}").toLocalIterator())  # rules are program text
    source_id = _register(spark, tables, a.case, a.host or "", a.files, "yara")
    scanned = yara.scan_files(spark, a.files, text, a.case, a.host or "", seconds=a.seconds).cache()
    _show(scanned.groupBy("state").agg(F.count(F.lit(1)).alias("n")).orderBy("state"))
    hits = scanned.where("state = 'matched'").withColumns({"source_id": F.lit(source_id), "source": F.lit("yara"), "description": F.concat("rule", F.lit(" matches "), "path"), "dedup_key": F.col("artifact_id"), "raw_data": F.to_json(F.struct("path", "sha256", "rule", "matched_on")), "is_noise": F.lit(False)})
    held = hits.select(*[(F.col(f.name) if f.name in hits.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in store.model.ARTIFACT])
    tables.put_source(a.case, source_id, held)
    score = F.coalesce(*[F.when(F.col("severity") == s, n) for s, n in store.model.DEFAULT_SCORE.items()], F.lit(store.model.DEFAULT_SCORE["high"]))
    return hits.select("artifact_id", "case_id", F.lit("yara").alias("engine"), F.col("rule").alias("rule_id"), F.col("rule").alias("rule_title"), "severity", score.alias("score"), "attack", "matched_on")


def detect(spark: SparkSession, tables: store.Store, a: argparse.Namespace) -> None:
    """Runs rules, Sigma documents, correlations, indicators and content rules over the case, or one host of it; what each engine had found there before goes."""
    if a.yara:
        tables.put_detections(a.case, "yara", _scan(spark, tables, a), a.host)
    mine = _case(tables, "artifacts", a)
    found = {}
    if a.rules:
        found["rules"] = rules.detect(mine, rules.read_rules(spark, a.rules))
    if a.sigma:
        told, refused = sigma.assemble([doc for _, doc in sigma.read_corpus(spark, a.sigma)])
        print(f"{len(told)} Sigma rules, {len(refused)} refused")
        found["sigma"] = sigma.detect(mine, told)
    if a.feeds:
        feeds = containers.load_feeds(spark, a.feeds)
        if feeds is not None:
            found["ioc"] = ioc.match(mine, ioc.merge_feeds(feeds))
    for engine, rows in found.items():
        tables.put_detections(a.case, engine, rows, a.host)
    tables.put_detections(a.case, "correlation", correlate.run_all(mine, _case(tables, "detections", a).where(F.col("engine") != "correlation"), a.window), a.host)
    _show(report.findings(_case(tables, "detections", a)))


def pipeline(spark: SparkSession, tables: store.Store, a: argparse.Namespace) -> None:
    """Ingests a source, detects in the case and writes its report."""
    ingest(spark, tables, a)
    a.host = None  # rules and correlations see the whole case
    detect(spark, tables, a)
    write_report(spark, tables, a)


def clusters(spark: SparkSession, tables: store.Store, a: argparse.Namespace) -> None:
    found = cluster.clusters(_case(tables, "detections", a), _case(tables, "artifacts", a), a.min_rules)
    _show(found.select("score", "rule_count", "host", "key", "names", "severity"), a.top)


def coverage(spark: SparkSession, tables: store.Store, a: argparse.Namespace) -> None:
    found = rules.coverage(rules.read_rules(spark, a.rules), _case(tables, "artifacts", a))
    _show(found.groupBy("state").agg(F.count(F.lit(1)).alias("rules")).orderBy("state"))
    _show(summary.wanted_types(found))


def stats(spark: SparkSession, tables: store.Store, a: argparse.Namespace) -> None:
    _show(store.case_health(tables.read("artifacts"), a.case))
    _show(store.types_by_count(tables.read("artifacts"), a.case))


def show_timeline(spark: SparkSession, tables: store.Store, a: argparse.Namespace) -> None:
    every = store.v_timeline(_case(tables, "artifacts", a), _case(tables, "detections", a))
    _show(timeline.query(every, a.case, artifact_type=a.type, layer=a.layer, host=a.host, keyword=a.keyword, flagged_only=a.flagged, limit=a.limit), a.limit)


def write_report(spark: SparkSession, tables: store.Store, a: argparse.Namespace) -> None:
    """The report page, the timeline and the Navigator layer of a case, in one folder."""
    artifacts, found = _case(tables, "artifacts", a), _case(tables, "detections", a)
    which = rules.read_rules(spark, a.rules) if a.rules else []
    report.write_report(f"{a.out}/report.html", f"{a.case}, by {a.analyst}", report.case_sections(a.case, artifacts, found, tables.read("evidence"), which))
    timeline.export_html(timeline.query(store.v_timeline(artifacts, found), a.case, hide_noise=not a.include_noise), f"{a.out}/timeline.html", a.case)
    attack.navigator_layer(found, artifacts, attack.pairs_frame(spark, attack.COVERAGE, "prefix", "technique"), f"{a.out}/layer.json", a.case)


def compare(spark: SparkSession, tables: store.Store, a: argparse.Namespace) -> None:
    _show(store.compare_cases(tables.read("detections"), a.baseline, a.case))


def rulesets(spark: SparkSession, tables: store.Store, a: argparse.Namespace) -> None:
    """What a folder of YARA files holds, and which of its rules can run where."""
    found = yara.ruleset(spark, a.yara)
    _show(yara.triage(found))
    _show(yara.file_only_reasons(found))


def _case(tables: store.Store, name: str, a: argparse.Namespace) -> DataFrame:
    mine = tables.read(name).where(F.col("case_id") == a.case)
    return mine.where(F.col("host") == a.host) if name == "artifacts" and a.host else mine


def _show(df: DataFrame, n: int = 50) -> None:
    df.show(n, truncate=80)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracelake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--store", required=True, help="folder of the tables, on any file system that Spark reads")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, host: bool = False) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=(run.__doc__ or name).split("\n")[0])
        c.add_argument("--case", required=True)
        c.add_argument("--host", required=host)
        c.set_defaults(run=run)
        return c

    def ingesting(c: argparse.ArgumentParser) -> None:
        c.add_argument("path")
        c.add_argument("--kind", choices=["tables", "collection", "memory", "browsers"], required=True)
        c.add_argument("--include-mft", action="store_true")
        c.add_argument("--acquired", help="time of a memory capture")

    def detecting(c: argparse.ArgumentParser) -> None:
        for name in ("--rules", "--sigma", "--feeds", "--yara"):
            c.add_argument(name)
        c.add_argument("--files", default=".", help="folder that --yara rules are run over")
        c.add_argument("--seconds", type=float, default=yara.SECONDS, help="time limit of a file's scan")
        c.add_argument("--window", type=int, default=60, help="minutes from a download to its execution")

    def reporting(c: argparse.ArgumentParser) -> None:
        c.add_argument("--out", required=True)
        c.add_argument("--analyst", default="unspecified")
        c.add_argument("--include-noise", action="store_true")

    c = commands.add_parser("init", help=init.__doc__)
    c.set_defaults(run=init)
    ingesting(command("ingest", ingest, host=True))
    detecting(command("detect", detect))
    c = command("pipeline", pipeline, host=True)
    for add in (ingesting, detecting, reporting):
        add(c)
    c = command("clusters", clusters)
    c.add_argument("--top", type=int, default=15)
    c.add_argument("--min-rules", type=int, default=2)
    command("coverage", coverage).add_argument("--rules", required=True)
    command("stats", stats)
    c = command("timeline", show_timeline)
    for name in ("--layer", "--type", "--keyword"):
        c.add_argument(name)
    c.add_argument("--flagged", action="store_true")
    c.add_argument("--limit", type=int, default=100)
    c = command("report", write_report)
    reporting(c)
    c.add_argument("--rules")
    command("compare", compare).add_argument("--baseline", required=True)
    c = commands.add_parser("rules", help=rulesets.__doc__)
    c.add_argument("--yara", required=True)
    c.set_defaults(run=rulesets)
    return p


def main(argv: list[str]) -> None:
    a = parser().parse_args(argv)
    spark = session.configure(SparkSession.builder.appName("tracelake")).getOrCreate()
    a.run(spark, store.Store(spark, a.store), a)


if __name__ == "__main__":
    main(sys.argv[1:])
