"""The four tables as DataFrames: upserts, first-writer-wins inserts, replacement, views.

A Store changes several partitions of several tables as one step: new partitions are written to a
folder of their own, which one rename marks as ready; ready folders are then moved into place. A job
that dies before the rename has changed nothing; after it, whoever opens the store next finishes the
moves. Readers of other processes may miss a partition for the moment in which it is moved.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake import model

TABLES = {"evidence": (model.EVIDENCE, []), "artifacts": (model.ARTIFACT, ["case_id", "source_id"]), "detections": (model.DETECTION, ["case_id", "engine"])}
EVIDENCE_KEY = ["case_id", "host", "source_path"]
#: Overwritten by an upsert even with null.
ALWAYS_NEW = ("status", "error")


def first_writer(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row a key: the first in ``order`` (ties: any of the equal rows)."""
    return df.withColumn("nth__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth__ = 1").drop("nth__")


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str], *order) -> DataFrame:
    """Rows of ``new`` whose key isn't stored yet, one a key: an insert that ignores conflicts.

    Stored rows are reduced to the keys that are also new before anything else is done with them: where the new
    keys are few, Spark broadcasts them and shuffles no stored row.
    """
    again = stored.select(*keys).join(new.select(*keys).distinct(), keys, "left_semi").distinct()
    return first_writer(new, keys, *order).join(again, keys, "left_anti")


def insert_artifacts(stored: DataFrame, new: DataFrame) -> DataFrame:
    return insert_new(stored, new, ["dedup_key"], "artifact_id", "timestamp_utc")


def insert_detections(stored: DataFrame, new: DataFrame) -> DataFrame:
    return insert_new(stored, new, ["artifact_id", "rule_id", "engine"], "matched_on")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], always_new: tuple[str, ...] = ()) -> DataFrame:
    """Merge by key: a new non-null value replaces the stored one; ``always_new`` columns are replaced even by null."""
    s, n = stored.alias("s"), new.alias("n")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = s.withColumn("old__", F.lit(True)).alias("s").join(n.withColumn("new__", F.lit(True)).alias("n"), same, "full_outer")
    out = []
    for c in stored.columns:
        old, fresh = F.col(f"s.{c}"), F.col(f"n.{c}")
        out.append((F.when(F.col("new__"), fresh).otherwise(old) if c in always_new else F.coalesce(fresh, old)).alias(c))
    return both.select(*out)


def register_evidence(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence after registering sources; a source known by (case, host, path) keeps its source_id."""
    merged = upsert(stored, new.withColumn("source_id", F.lit(None).cast("string")), EVIDENCE_KEY, ALWAYS_NEW)
    return merged.withColumns({"source_id": F.coalesce("source_id", F.sha1(F.concat_ws("\x1f", *EVIDENCE_KEY))), "status": F.coalesce("status", F.lit("ok"))})


def clear_source(artifacts: DataFrame, detections: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a source's artifacts and what was detected on them."""
    gone = artifacts.where(F.col("source_id") == source_id).select("artifact_id")
    return artifacts.where(~F.col("source_id").eqNullSafe(F.lit(source_id))), detections.join(gone, "artifact_id", "left_anti")


def clear_detections(detections: DataFrame, case_id: str, engine: str | None = None) -> DataFrame:
    """Detections without those of a case, or of one engine in it."""
    mine = F.col("case_id") == case_id
    return detections.where(~(mine & (F.col("engine") == engine) if engine else mine))


def escape(value: str) -> str:
    """A partition's value as Spark spells it in a folder's name."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or c < " " else c for c in value)


class Store:
    """Parquet tables under one folder, partitioned so that a source or an engine of a case is replaced as a whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        """(Hadoop path, its file system)."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, path: str, only: str = "") -> list[str]:
        """Names of the folders in a folder, in order; none if it isn't there."""
        p, fs = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory() and f.getPath().getName().startswith(only)) if fs.exists(p) else []

    def read(self, name: str) -> DataFrame:
        self.recover()
        schema, _ = TABLES[name]
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def init(self) -> None:
        """Empty tables where there are none yet."""
        for name, (schema, _) in TABLES.items():
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(self.path(name))

    # --- several partitions as one step

    def commit(self, changes: dict[str, DataFrame], gone: list[tuple[str, dict[str, str]]]) -> None:
        """Removes the partitions of ``gone`` (table and values) and puts ``changes``' rows in their tables' partitions, replacing those that they fall into: all or nothing."""
        staged = f"{self.root}/_tmp-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        for name, rows in changes.items():
            schema, parts = TABLES[name]
            rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.partitionBy(*parts).parquet(f"{staged}/{name}")
        self.spark.createDataFrame([(f"{name}/{self._inside(name, values)}",) for name, values in gone], "path string").coalesce(1).write.text(f"{staged}/_gone")
        self._move(staged, staged.replace("/_tmp-", "/_ready-"))
        self.recover()

    def recover(self) -> None:
        """Moves what commits have made ready into place, in their order; a step that was done before an interruption isn't done again."""
        for name in self._listed(self.root, "_ready-"):
            ready = f"{self.root}/{name}"
            if "_gone" in self._listed(ready):
                for row in self.spark.read.text(f"{ready}/_gone").toLocalIterator():
                    self._delete(f"{self.root}/{row['value']}")
                self._move(f"{ready}/_gone", f"{ready}/_done")
            for table in self._listed(ready):
                inner = [table] if table in TABLES else []
                for _ in TABLES[table][1] if inner else ():
                    inner = [f"{d}/{x}" for d in inner for x in self._listed(f"{ready}/{d}") if "=" in x]
                for part in inner:
                    self._delete(f"{self.root}/{part}")
                    self._move(f"{ready}/{part}", f"{self.root}/{part}")
            self._delete(ready)

    def _delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def _move(self, old: str, new: str) -> None:
        (p, fs), (q, _) = self._fs(old), self._fs(new)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise OSError(f"can't move {old} to {new}")

    def _inside(self, name: str, values: dict[str, str]) -> str:
        return "/".join(f"{k}={escape(values[k])}" for k in TABLES[name][1])

    def put_source(self, case_id: str, source_id: str, found: DataFrame | None) -> None:
        """A source's artifacts, in place of those it had; what was detected on those goes.

        An artifact that another source of the case has already is not stored again.
        """
        stored = self.read("artifacts").where(F.col("case_id") == case_id)
        mine = F.col("source_id") == source_id
        changes, gone = {}, [("artifacts", {"case_id": case_id, "source_id": source_id})]
        if found is not None:
            # parsed once: keys are compared and rows kept from what was written
            parsed = f"{self.root}/_parsed-{uuid.uuid4().hex}"
            found.write.parquet(parsed)
            changes["artifacts"] = insert_artifacts(stored.where(~mine), self.spark.read.schema(model.ARTIFACT).parquet(parsed))
        detections = self.read("detections").where(F.col("case_id") == case_id)
        old = stored.where(mine).select("artifact_id")
        engines = [r["engine"] for r in detections.join(old, "artifact_id", "left_semi").select("engine").distinct().collect()]  # one row an engine
        if engines:
            changes["detections"] = detections.where(F.col("engine").isin(engines)).join(old, "artifact_id", "left_anti")
            gone += [("detections", {"case_id": case_id, "engine": e}) for e in engines]
        self.commit(changes, gone)
        if found is not None:
            self._delete(parsed)

    def put_detections(self, case_id: str, engine: str, rows: DataFrame, host: str | None = None) -> None:
        """An engine's detections in a case, in place of those it had: all of them, or with ``host`` those on the host's artifacts."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in model.DETECTION])
        if host is not None:
            own = self.read("artifacts").where((F.col("case_id") == case_id) & (F.col("host") == host)).select("artifact_id")
            before = self.read("detections").where((F.col("case_id") == case_id) & (F.col("engine") == engine))
            rows = rows.unionByName(before.join(own, "artifact_id", "left_anti"))
        self.commit({"detections": rows}, [("detections", {"case_id": case_id, "engine": engine})])

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes rows over the partitions that they fall into; others stay."""
        schema, parts = TABLES[name]
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (out.partitionBy(*parts) if parts else out).parquet(self.path(name))

    def drop(self, name: str, **values: str) -> None:
        """Deletes the partition of these values, if there; replace() alone keeps a partition that gets no rows."""
        self._delete(f"{self.path(name)}/{self._inside(name, values)}")

    def rewrite_evidence(self, rows: DataFrame) -> None:
        """Evidence is small: it is written beside the old table's rows, which it was computed from, and then replaces them."""
        rows = rows.select(*model.EVIDENCE.fieldNames())
        kept = self.spark.createDataFrame(rows.collect(), model.EVIDENCE)  # one row a source
        kept.write.mode("overwrite").parquet(self.path("evidence"))


# --- views ---------------------------------------------------------------------------------------------

def v_artifacts(artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row an artifact, with its source's custody columns; no time if none was parsed."""
    told = evidence.select("source_id", F.col("os").alias("evidence_os"), "tool")
    return artifacts.join(told, "source_id").withColumn("source", F.coalesce("tool", "source")).drop("tool")


def v_timeline(artifacts: DataFrame, detections: DataFrame) -> DataFrame:
    """One row a timestamp, with the number and points of the artifact's detections."""
    scores = detections.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("score").alias("score"))
    stamps = artifacts.select("artifact_id", "case_id", "host", "source", "artifact_type", "description", "is_noise", F.inline("events"))
    return stamps.join(scores, "artifact_id", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)).cast("long"), "score": F.coalesce("score", F.lit(0)).cast("long")})


def v_detections(detections: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Detections with the artifact's host, type, description and primary time."""
    return detections.join(artifacts.select("artifact_id", "host", "source", "artifact_type", "description", "timestamp_utc"), "artifact_id")


def case_health(artifacts: DataFrame, case_id: str) -> DataFrame:
    """One row: artifacts, hosts, artifacts without a time, noise, first and last time."""
    mine = artifacts.where(F.col("case_id") == case_id)
    return mine.agg(F.count(F.lit(1)).alias("artifacts"), F.array_sort(F.collect_set("host")).alias("hosts"), F.count_if(F.col("timestamp_utc").isNull()).alias("no_time"), F.count_if("is_noise").alias("noise"), F.min("timestamp_utc").alias("first_seen"), F.max("timestamp_utc").alias("last_seen"))


def types_by_count(artifacts: DataFrame, case_id: str) -> DataFrame:
    return artifacts.where(F.col("case_id") == case_id).groupBy("artifact_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "artifact_type")


def compare_cases(detections: DataFrame, a: str, b: str) -> DataFrame:
    """Hits of each rule in two cases, by difference, and whether b has more, the same or fewer."""
    n = detections.where(F.col("case_id").isin(a, b)).groupBy("rule_id", "rule_title").agg(F.count_if(F.col("case_id") == a).alias("n_a"), F.count_if(F.col("case_id") == b).alias("n_b"))
    diff = F.col("n_b") - F.col("n_a")
    return n.withColumns({"diff": diff, "change": F.when(diff > 0, "more").when(diff < 0, "fewer").otherwise("same")}).orderBy(F.desc("diff"), "rule_id")
