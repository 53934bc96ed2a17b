"""The training-data pipeline: its stages in order, each (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import stages

STAGES = [
    ("language_id", stages.language_stage),
    ("toxicity", stages.toxicity_stage),
    ("ngram_jaccard_join", stages.dedup_stage),
    ("entropy_mixing", stages.mixing_stage),
    ("best_fit_packing", stages.packing_stage),
]

#: The classifiers of the first two stages can't be written in SQL; tests/llm/test_pipeline.py holds run() against the stages' definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``, each written as Parquet and read again."""
    return stages.run_stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, STAGES)
