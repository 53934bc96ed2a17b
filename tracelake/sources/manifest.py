"""Evidence manifests: hashes of collected files, and what changed since."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources import files

#: Runs are folders that are named by their time.
STAMP = re.compile(r"\d{8}T\d{6}Z")


def hash_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of every file below a folder, of any size and name; a file is streamed by a task."""
    return files.digests(files.listing(spark, folder))


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """One row: digest over all files in path order. The list has one short entry a file."""
    entries = F.array_sort(F.collect_list(F.struct("path", "size", "sha256")))
    return manifest.agg(F.sha2(F.to_json(entries), 256).alias("manifest_sha256"), F.count(F.lit(1)).alias("files"))


def compare(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state): changed, missing or added files; unchanged ones are left out. Local paths are alike with and without ``file:``."""
    path = F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("path")
    a, b = manifest.select(path, F.col("sha256").alias("was")), found.select(path, F.col("sha256").alias("is"))
    state = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state")).where("state is not null")


def runs(spark: SparkSession, parent: str) -> list[str]:
    """Paths of the folders directly in ``parent``, by name, on any file system that Spark reads; none if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return [p.toString() for p in sorted(found, key=lambda p: p.getName())]


def latest_run(spark: SparkSession, parent: str) -> str | None:
    """The last run by the time in its name; without any such name the last folder."""
    found = runs(spark, parent)
    stamped = [p for p in found if STAMP.fullmatch(p.rsplit("/", 1)[1])]
    return (stamped or found or [None])[-1]
