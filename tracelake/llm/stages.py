"""Stages of the training-data pipeline.

Each takes (spark, docs, sf_dir) and, but for the last, returns the columns of documents that
it was given. Stages read everything their predecessor kept.

Columns beside OWN may have any name, with dots, backticks, or one that differs from another in case
only: a stage works under plain names and hands the columns on under their own. run_stages() writes
Parquet in between, and Spark refuses to write two names that differ in case only.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import jaccard, langid, mixing, packing, toxicity
from .common import WORD, fresh, release, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A text is rejected as no language if no language reaches this score.
LEAST_SCORE = 0.15
#: The columns of documents that stages know.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def plain_names(stage: Stage) -> Stage:
    """``stage`` over columns whose names can't be misread; of names that differ in case only the one spelled as in OWN is meant, else the first."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        meant = {}
        for own in OWN:
            at = [i for i, c in enumerate(names) if c == own] or [i for i, c in enumerate(names) if c.lower() == own]
            meant |= {at[0]: own} if at else {}
        plain = [meant.get(i, f"other{i}__") for i in range(len(names))]
        if all(c.isidentifier() and c.isascii() for c in names) and len({c.lower() for c in names}) == len(names):
            return stage(spark, docs, sf_dir)
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*names)

    return run


@plain_names
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those that are ``und`` or score below LEAST_SCORE go.

    Null, empty and letterless texts go; a null lang teaches nothing, and with nothing to learn
    from all go; repeated rows are each judged; an empty table stays empty; columns of any name
    are handed on as they were.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    lang, score = fresh(docs.columns, "lang_pred", "score")
    told = langid.predict(docs, model, docs.columns, (lang, score))
    return told.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


@plain_names
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic; it learns from the labels table.

    A null or empty text stays; without labels all stay; repeated rows are each judged; an empty
    table stays empty; columns of any name are handed on as they were.
    """
    chain = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels")), ["low_quality", "toxic"])
    names = fresh(docs.columns, "p_low_quality", "p_toxic")
    return toxicity.predict(docs, chain, docs.columns, names).where(F.col(names[1]) < toxicity.THRESHOLD).select(*docs.columns)


@plain_names
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Null ids come last; of rows with one id the one with the smallest 64-bit hash of its text
    stays, and of rows alike in both the one with the smallest hash of its other columns.
    Documents without words are in no group and all stay; an empty table stays empty; columns
    of any name and kind are handed on.
    """
    keys = ("absent", "id", "th")
    absent, key, th, nth = fresh(docs.columns, *keys, "nth")
    heads = jaccard.representatives(docs).select(*[F.col(k).alias(c) for k, c in zip(keys, (absent, key, th), strict=True)])
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    worded = text.rlike(WORD)
    rest = F.xxhash64(F.to_json(F.struct(F.lit(0).alias("a"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")])))
    # rows alike are reduced in each task before anything is shuffled; heads meet the same partitions
    order = Window.partitionBy(absent, key, th).orderBy(rest)
    keyed = docs.where(worded).withColumns({absent: doc_id.isNull(), key: F.coalesce(doc_id, F.lit(0)), th: F.xxhash64(text)})
    kept = keyed.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).join(heads, [absent, key, th], "left_semi")
    return kept.select(*docs.columns).unionByName(docs.where(~worded))


@plain_names
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs, carry=docs.columns)
    copies = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: the pieces of every document and copy, with their places."""
    return packing.pack(docs)


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str, stages: list[tuple[str, Stage]]) -> DataFrame:
    """The last stage's result; each stage's is written as Parquet in the shared folder and read as the next one's input."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(stages):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        release(spark)
    return docs
