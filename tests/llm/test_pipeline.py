"""The whole pipeline against the definition of each stage, over all documents of a small table."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_joins_search_and_chat import brute
from tests.llm.test_sharding_mixing_packing import brute_targets
from tracelake.llm import langid, packing, stages, toxicity
from tracelake.llm.tokens import WordBPE


def test_run_equals_its_stages_one_by_one(spark, tiny):
    """Rejections from the models' own scores, near copies by comparing all pairs, targets by their definition, and each copy packed whole."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = corpus_pipeline.run(spark, tiny).toPandas()
    assert list(out.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    names, scores = model.predict([r["text"] for r in rows.values()])
    spoken = [i for i, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= stages.LEAST_SCORE]
    kept = spark.createDataFrame([rows[i] for i in spoken], docs.schema)
    chain = toxicity.fit(toxicity.labelled(kept, spark.read.parquet(f"{tiny}/labels.parquet")), ["low_quality", "toxic"])
    p = toxicity.sigmoid(chain.logits(*toxicity.counts([rows[i]["text"] or "" for i in spoken])))[:, 1]
    calm = [i for i, x in zip(spoken, p, strict=True) if x < toxicity.THRESHOLD]
    groups = defaultdict(list)
    for i, _, head in brute([(i, rows[i]["text"]) for i in calm]):
        groups[head].append(int(i))
    heads = sorted(min(g) for g in groups.values())

    size = {i: len([w for w in (rows[i]["text"] or "").split()]) for i in heads}
    by_source = Counter()
    for i in heads:
        by_source[rows[i]["source"]] += size[i]
    target = brute_targets(dict(by_source))
    bpe = WordBPE(packing.vocabulary_path())
    tokens = {i: len(b) // 4 + 1 for i, b in zip(heads, bpe.encode_bytes([rows[i]["text"] or "" for i in heads]), strict=True)}
    packed = out.groupby("doc_id")["length"].sum()
    assert set(packed.index) <= set(heads)
    taken = Counter()
    for i in heads:
        copies, rest = divmod(int(packed.get(i, 0)), tokens[i])
        assert rest == 0 and copies <= 3
        taken[rows[i]["source"]] += copies * size[i]
    assert all(abs(taken[s] - t) <= 0.1 * t + max(size.values()) for s, t in target.items())
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.iloc[0] == 0 and (g.offset.iloc[1:].to_numpy() == (g.offset + g.length).iloc[:-1].to_numpy()).all() and g.length.sum() <= packing.LIMIT


@pytest.mark.parametrize("stage", [stages.language_stage, stages.toxicity_stage, stages.dedup_stage, stages.mixing_stage])
def test_columns_of_any_name_are_handed_on(spark, tiny, stage):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    plain = stage(spark, docs, tiny).orderBy("doc_id").collect()
    odd = docs.withColumns({"x0": F.col("doc_id") * 2, "x1": F.lit("b"), "x2": F.upper("text"), "x3": F.lit(None).cast("string")}).toDF(*docs.columns, "a.b", "a`b", "Text", "score")
    got = stage(spark, odd, tiny)
    assert got.columns == odd.columns
    rows = sorted(tuple(r) for r in got.select("doc_id", F.col("`a.b`")).collect())
    assert rows == sorted((r.doc_id, 2 * r.doc_id) for r in plain)
