"""Language identification by string kernels.

The kernel of two texts counts the character n-grams (n = 1..3, blended spectrum, presence)
that both have, divided by the square root of the product of their own counts. Nyström
landmarks are a bounded sample; one-versus-rest kernel ridge regression on the landmark
features gives a score a language. A batch is scored by two dense matrix products: presence
times landmarks, then kernel values times dual weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh
from .textbytes import code_points, letters, mix

BINS = 1 << 14
GRAMS = (1, 2, 3)
#: Bounds of the fitted sample: texts a language, and landmarks in all.
SAMPLE, LANDMARKS, RIDGE = 300, 128, 0.1
#: Code points of a call's temporaries, of some 50 bytes each; a longer text is a call of its own.
BATCH_CHARS = 1 << 19
#: Languages whose table is broadcast, of some 100 bytes each.
FEW_LANGUAGES = 10_000


def presence(texts: list[str], out: np.ndarray) -> np.ndarray:
    """Marks in ``out`` (rows, BINS) the n-grams of each text; returns whether a text has a letter.

    A text's end counts as one more character that is no letter, so a last word ends like any other.
    """
    cp, at = code_points([t.lower() for t in texts])
    is_letter = letters()[cp]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
    cp = np.where(is_letter, cp, 0).astype(np.uint64)
    marks = out.reshape(-1)
    for n in GRAMS:
        m = len(cp) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n), np.uint64)
        some = np.zeros(m, bool)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + cp[j : j + m]
            some |= is_letter[j : j + m]
        keep = some & (row[:m] == row[n - 1 :])
        marks[row[:m][keep] * BINS + (mix(h[keep]) & np.uint64(BINS - 1)).astype(np.int64)] = 1
    return np.bincount(row[is_letter], minlength=len(texts)) > 0


def _batches(texts: list[str]):
    """Ranges of texts whose presence matrix and temporaries stay small."""
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or (hi - lo < 256 and chars + len(texts[hi]) <= BATCH_CHARS)):
            chars += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # BINS x landmarks, columns of unit length
    weights: np.ndarray  # landmarks x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        plain = [t or "" for t in texts]
        for lo, hi in _batches(plain):
            x = np.zeros((hi - lo, BINS), np.float32)
            some = presence(plain[lo:hi], x)
            if not self.languages:
                names += ["und"] * (hi - lo)
                scores.append(np.zeros(hi - lo))
                continue
            kernel = (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
            f = kernel @ self.weights
            best = f.argmax(1)
            names += [self.languages[b] if s else "und" for b, s in zip(best, some, strict=True)]
            scores.append(np.where(some, np.clip(f[np.arange(hi - lo), best], 0, 1), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, mod 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(labelled: DataFrame, per_language: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """A model from (text, lang) rows; rows without a lang or without a letter teach nothing.

    Fitted on at most ``per_language`` texts of each language, those with the smallest hash of
    (doc_id, text); every language is learned. The sample reaches the driver a language after
    the other, as n-gram bin sets of at most 32 kB each, and is kept as kernel values against
    the landmarks: ``landmarks`` doubles a text.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    # a hash threshold keeps the candidates of each language few before any row is compared
    sizes = cut(rows.groupBy(F.col("lang").alias("l")).agg((F.lit(3.0 * per_language + 50) / F.count(F.lit(1))).alias("rate")))
    # one row a language: broadcast if they are few, so that texts aren't shuffled by language; else joined, with the same result
    sizes = F.broadcast(sizes) if sizes.count() <= FEW_LANGUAGES else sizes
    some = rows.join(sizes, F.col("lang") == F.col("l")).where((F.col("key") / F.lit(2.0**64) + 0.5) <= F.col("rate"))

    def bins(batches):
        import pyarrow as pa

        for batch in batches:
            texts, got = batch.column("text").to_pylist(), []
            for lo, hi in _batches(texts):
                x = np.zeros((hi - lo, BINS), np.uint8)
                ok = presence(texts[lo:hi], x)
                got += [np.flatnonzero(r).astype(np.uint16).tobytes() if o else b"" for r, o in zip(x, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), pa.array(got, pa.binary())], names=["lang", "key", "bins"])

    sets = some.select("lang", "text", "key").mapInArrow(bins, "lang string, key long, bins binary").where(F.length("bins") > 0)
    order = Window.partitionBy("lang").orderBy("key", "bins")
    sets = cut(sets.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language))
    languages = sorted(r["lang"] for r in sets.select("lang").distinct().toLocalIterator())
    if not languages:
        return LanguageModel([], np.zeros((BINS, 0), np.float32), np.zeros((0, 0), np.float32))
    each = max(1, landmarks // len(languages))
    marks = np.stack([_unit(r["bins"]) for r in sets.where(F.col("nth") <= each).orderBy("lang", "nth").toLocalIterator()])
    kernel, y = [], []
    for r in sets.orderBy("lang", "nth").toLocalIterator():
        own = np.frombuffer(bytes(r["bins"]), np.uint16)
        kernel.append(marks[:, own].sum(1, dtype=np.float64) / np.sqrt(len(own)))
        y.append(r["lang"])
    y = np.searchsorted(np.array(languages), np.array(y))
    return LanguageModel(languages, np.ascontiguousarray(marks.T), kernel_ridge((marks @ marks.T).astype(np.float64), np.array(kernel), y, len(languages), ridge))


def kernel_ridge(k_mm: np.ndarray, k_nm: np.ndarray, y: np.ndarray, languages: int, ridge: float) -> np.ndarray:
    """Weights on kernel values against the landmarks, one column a language.

    Nyström features are k_nm K_mm ** -1/2; on them each language is fitted against the rest by
    ridge regression. Every language counts alike, however many texts it has.
    """
    values, vectors = np.linalg.eigh(k_mm)
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6)))
    phi, w = k_nm @ root, (1 / np.bincount(y, minlength=languages))[y]
    dual = np.linalg.solve(phi.T @ (phi * w[:, None]) + ridge / len(y) * np.eye(len(k_mm)), phi.T @ (np.eye(languages)[y] * w[:, None]))
    return (root @ dual).astype(np.float32)


def _unit(bins: bytes) -> np.ndarray:
    """A landmark's column: 1 / sqrt(n) at its n bins."""
    at, v = np.frombuffer(bytes(bins), np.uint16), np.zeros(BINS, np.float32)
    v[at] = 1 / np.sqrt(len(at))
    return v


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, unchanged, and language and score of every whole text under ``names``; und where text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BINS x LANDMARKS floats
    (text,) = ("text",) if "text" in keep else fresh([*keep, *names], "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            told, scores = shared.value.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(told, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    kept = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").alias(text))
    return kept.mapInArrow(run, docs.select(*keep).withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema)


def identify(docs: DataFrame) -> DataFrame:
    """Language of every document, learned from the documents that aren't held out.

    Defined cases: a null text or one without a letter is ``und`` with score 0; a null lang
    teaches nothing; with nothing to learn from all are ``und``; repeated rows are each
    predicted; an empty table gives an empty result; other columns are ignored. lang, source
    and doc_id are never inputs of a prediction.

    Returns doc_id, held_out, lang_pred, score.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    model = fit(plain.where(~held_out(F.col("doc_id"))))
    return predict(plain.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
