import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import langid, stages, textbytes, toxicity
from tests.llm.samples import DOCS, odd_documents


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


def test_held_out_accuracy(spark):
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def brute_bins(text):
    """Bins of the n-grams that hold a letter, of a lower-cased text and its end; the end and anything but letters are one character."""
    chars = [*(c if c.isalpha() else None for c in text.lower()), None]
    found = set()
    for n in langid.GRAMS:
        for i in range(len(chars) - n + 1):
            gram = chars[i : i + n]
            if any(gram):
                h = n
                for c in gram:
                    h = (h * 0x100000001B3 + (ord(c) if c else 0)) % (1 << 64)
                found.add(int(textbytes.mix(np.array([h], np.uint64))[0]) % langid.BINS)
    return found


def test_language_and_score_by_brute_force(spark, docs):
    """Each prediction against set intersections with the landmarks, over whole texts."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    marks = [set(np.flatnonzero(model.landmarks[:, j])) for j in range(model.landmarks.shape[1])]
    rows = [r for r in docs.select("doc_id", "text", "n_chars").collect() if r["n_chars"] and r["n_chars"] < 3000][:80]
    want = {}
    for r in rows:
        own = brute_bins(r["text"] or "")
        kernel = [len(own & m) / (len(own) * len(m)) ** 0.5 if own else 0.0 for m in marks]
        f = np.array(kernel) @ model.weights.astype(np.float64)
        want[r["doc_id"]] = (model.languages[int(f.argmax())], float(np.clip(f.max(), 0, 1))) if own else ("und", 0.0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model, ["doc_id"]).collect()}
    assert {d for d in want if got[d][0] != want[d][0] or abs(got[d][1] - want[d][1]) > 1e-3} == set()


def test_ridge_weights_by_the_normal_equations():
    """Nystroem features and their regression against the same problem solved in the landmarks' own weights."""
    rng = np.random.default_rng(1)
    x, m, y = rng.random((90, 12)), rng.random((6, 12)), rng.integers(0, 3, 90)
    k_mm, k_nm, ridge = m @ m.T, x @ m.T, 0.3
    w = (1 / np.bincount(y))[y][:, None]
    want = np.linalg.solve(k_nm.T @ (k_nm * w) + ridge / len(y) * k_mm, k_nm.T @ (np.eye(3)[y] * w))
    assert np.allclose(langid.kernel_ridge(k_mm, k_nm, y, 3, ridge), want, atol=1e-3)


def test_odd_rows_and_whole_texts(spark, docs):
    model = langid.fit(docs)
    german = next(r["text"] for r in docs.where("lang = 'de'").orderBy(F.desc("n_chars")).collect())
    rows = [(1, None), (2, ""), (3, "123 !!! 456"), (4, german), (5, "... " * 20000 + german), (4, german)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"]).toPandas()
    assert list(got.lang_pred) == ["und", "und", "und", "de", "de", "de"] and (got.score[:3] == 0).all()


def test_clashing_and_missing_columns(spark, docs):
    rows = docs.limit(60).withColumns({"score": F.lit("x"), "held_out": F.lit("y"), "text__x": F.lit(1)})
    assert langid.identify(rows).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert langid.identify(docs.where("false")).count() == 0
    none = langid.identify(docs.limit(20).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_toxic_documents_are_found_and_clean_ones_left_alone(spark):
    from tests.conftest import DATA

    docs, labels = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    known = toxicity.labelled(docs, labels)
    chain = toxicity.fit(known.where("doc_id % 3 <> 0"), ["low_quality", "toxic"])
    got = toxicity.predict(known.where("doc_id % 3 = 0"), chain, ["doc_id", "toxic"]).toPandas()
    hit = got.p_toxic >= toxicity.THRESHOLD
    assert (got.toxic[hit] == 1).mean() > 0.95 and hit[got.toxic == 1].mean() > 0.85


def test_chain_probabilities_by_brute_force(spark, tiny):
    """Log odds from words and their beginnings counted in Python, category after category."""
    texts = [r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").where("n_chars < 3000").orderBy("doc_id").limit(60).collect()]
    row, col, n, runs = toxicity.counts(texts)
    words = ["".join(c if c.isalpha() else " " for c in t.lower()).split() for t in texts]
    seen = Counter()
    for i, found in enumerate(words):
        seen[i] = len(found) + sum(len(w) >= p for w in found for p in toxicity.PREFIXES)
    assert list(runs) == [len(w) for w in words]
    assert [int(n[row == i].sum()) for i in range(len(texts))] == [seen[i] for i in range(len(texts))]
    rng = np.random.default_rng(2)
    chain = toxicity.Chain(["a", "b", "c"], [rng.normal(size=toxicity.BINS) for _ in range(3)], [rng.normal(size=1 + k) for k in range(3)])
    got = chain.logits(row, col, n, runs)
    for i in range(len(texts)):
        known = []
        for k in range(3):
            z = chain.rest[k][0] + sum(float(c) * p for c, p in zip(chain.rest[k][1:], known, strict=True))
            z += sum(np.log1p(m) / (1 + np.log1p(len(words[i]) / 400)) * chain.bins[k][b] for b, m in zip(col[row == i], n[row == i], strict=True))
            assert abs(got[i, k] - z) < 1e-6
            known.append(1 / (1 + np.exp(-min(max(z, -40), 40))))


def test_chain_feeds_earlier_categories(spark):
    """The second category is the first one's opposite wherever a word says so; only the chain can know the rest."""
    rows = [(i, ("alpha " if i % 2 else "beta ") * 3 + f"filler{i % 7}", i % 2, i % 2) for i in range(200)]
    chain = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, a int, b int"), ["a", "b"])
    assert chain.rest[1][1] > 0
    z = chain.logits(*toxicity.counts(["alpha alpha", "beta beta"]))
    assert z[0].min() > 0 > z[1].max()


def test_toxicity_of_odd_rows(spark, docs, tiny):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    got = toxicity.classify(odd_documents(spark), labels)
    assert got.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"] and got.count() == len(DOCS)
    assert toxicity.classify(docs, labels.where("false")).where("toxic").count() == 0
    assert toxicity.classify(docs.where("false"), labels).count() == 0


def test_stages_keep_columns_and_clean_documents(spark, docs, tiny):
    kept = stages.language_stage(spark, docs, tiny)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    calm = stages.toxicity_stage(spark, docs, tiny)
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    clean = docs.join(labels.where("toxic = 0"), "doc_id", "left_semi")
    assert calm.columns == docs.columns and calm.join(clean.select("doc_id"), "doc_id", "left_semi").count() >= 0.97 * clean.count()


BIG = 2**53 + 1


def test_ids_beside_nulls_are_exact(spark, docs, tiny):
    rows = spark.createDataFrame([(BIG, "ein kurzer Text"), (None, "another text"), (-BIG, None)], "doc_id long, text string").coalesce(1)
    model = langid.fit(docs)
    assert {r["doc_id"] for r in langid.predict(rows, model, ["doc_id"]).collect()} == {BIG, None, -BIG}
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    chain = toxicity.fit(toxicity.labelled(docs, labels), ["low_quality", "toxic"])
    assert {r["doc_id"] for r in toxicity.predict(rows, chain, ["doc_id"]).collect()} == {BIG, None, -BIG}


def test_every_language_is_learned(spark):
    """200 languages, the common ones with many texts: each is in the model."""
    rows = [(i, f"k{i % 200} " + "abc"[i % 3], f"l{i % 200:03}") for i in range(1000)] + [(2000 + i, f"viel {i}", "l000") for i in range(1500)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
    assert len(model.languages) == 200 and model.weights.shape == (200, 200)


def grams(text):
    """The definition: letters of the lower-cased text and an end mark, other code points like that mark, n-grams of 1 to 3 with a letter."""
    t = "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i : i + n].strip("\0")}


def test_kernel_scores_equal_brute_force(spark):
    """Kernels over sets of n-grams, K_mm ** -1/2 and ridge regression written out over the same texts."""
    import numpy as np

    words = {"a": "der die das und nicht ist ein Haus", "b": "the and not is a house of some", "c": "le la les et pas est une maison"}
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words[k].split(), 6)), k) for i, k in enumerate("abc" * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, per_language=5, landmarks=9, ridge=0.1)
    keyed = sorted((r["lang"], r["key"], r["text"]) for r in df.select("lang", "text", F.xxhash64("doc_id", "text").alias("key")).collect())
    sample = [t for k in "abc" for t in [r[2] for r in keyed if r[0] == k][:5]]
    marks = [t for i, t in enumerate(sample) if i % 5 < 3]
    k = lambda x, y: len(grams(x) & grams(y)) / np.sqrt(len(grams(x)) * len(grams(y)))
    k_mm, k_nm = (np.array([[k(x, y) for y in marks] for x in xs]) for xs in (marks, sample))
    values, vectors = np.linalg.eigh(k_mm)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    phi = k_nm @ root
    dual = np.linalg.solve(phi.T @ phi / 5 + 0.1 / 15 * np.eye(9), phi.T @ np.repeat(np.eye(3), 5, 0) / 5)
    new = ["das Haus ist nicht", "not a house", "la maison et le Haus", "house"]
    want = np.array([[k(x, y) for y in marks] for x in new]) @ root @ dual
    told, scores = model.predict(new)
    # n-grams that share one of 2**14 bins move a kernel value by little
    assert told == [model.languages[i] for i in want.argmax(1)] and np.abs(scores - np.clip(want.max(1), 0, 1)).max() < 0.03


def test_chain_equals_its_definition():
    """Two logistic models by plain gradient steps, the second fed with out-of-fold probabilities, reach the same coefficients."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([np.ones((90, 1)), rng.normal(size=(90, 4))], 1).astype(np.float32)
    y = (x @ [0.2, 1, -1, 0.5, 0] + rng.normal(size=90) > 0).astype(float)
    use = np.arange(90) % 3 != 0
    w, z = np.zeros(5), x[use].astype(float)
    pen = np.array([0, 1, 1, 1, 1]) * 0.05
    for _ in range(20000):
        w -= 0.2 * (z.T @ (1 / (1 + np.exp(-z @ w)) - y[use]) / use.sum() + pen * w)
    assert np.allclose(toxicity._logistic(x, y, use, ridge=0.05, steps=600), w, atol=2e-3)


def test_stages_keep_clashing_columns(spark, docs, tiny):
    odd = docs.limit(80).withColumns({c: F.lit("mine") for c in ("score", "lang_pred", "p_toxic", "p_low_quality", "text_", "head", "nth", "id")}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    for stage in (stages.language_stage, stages.toxicity_stage, stages.dedup_stage):
        kept = stage(spark, odd, tiny)
        assert kept.columns == odd.columns
        assert {tuple(r) for r in kept.select("score", "lang_pred", "p_toxic", "p_low_quality", "text_", "head", "nth", "id").distinct().collect()} == {("mine",) * 8}
