"""Toxicity by a classifier chain.

Categories are predicted in a fixed order; each later linear model also reads the
probabilities of the earlier ones. While fitting, those are out-of-fold predictions, so that a
later model learns how far it can trust them. Features of a text are log counts of its lower-cased
letter runs and of their anchored beginnings (4 to 7 letters), hashed to a fixed space; the
columns that the models use are chosen by their association with the labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh
from .textbytes import P, code_points, letters, mix, span_hashes

BINS = 1 << 18
PREFIXES = (4, 5, 6, 7)
#: Bounds of the fitted sample: labelled documents in all, and feature columns a category.
SAMPLE, COLUMNS = 8_000, 1_200
FOLDS, RIDGE, STEPS = 3, 2e-3, 150
#: A document is toxic from this probability on.
THRESHOLD = 0.35
#: Code points of a call's temporaries, of some 100 bytes each; a longer text is a call of its own.
BATCH_CHARS = 1 << 19


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, count) of the features of each text, sorted by row, and the letter runs of each row."""
    cp, at = code_points([t.lower() for t in texts])
    inside = letters()[cp]  # the 0 after each text is no letter
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1]))) if len(cp) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:], [True]))) + 1 if len(cp) else np.zeros(0, np.int64)
    row = np.searchsorted(at, starts, "right") - 1
    values = mix(cp.astype(np.uint64) + P)
    keys = [(row << 18) | (span_hashes(values, starts, ends) & np.uint64(BINS - 1)).astype(np.int64)]
    for n in PREFIXES:
        long = ends - starts >= n
        h = mix(span_hashes(values, starts[long], starts[long] + n) + np.uint64(n))
        keys.append((row[long] << 18) | (h & np.uint64(BINS - 1)).astype(np.int64))
    both, n = np.unique(np.concatenate(keys), return_counts=True)
    return both >> 18, both & (BINS - 1), n, np.bincount(row, minlength=len(texts))


def _ranges(texts: list[str]):
    lo, chars = 0, 0
    for i, t in enumerate(texts):
        if i > lo and (chars + len(t) > BATCH_CHARS or i - lo >= 4096):
            yield lo, i
            lo, chars = i, 0
        chars += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _weight(n: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """A feature's value: log count, less in longer texts, where chance hits are likelier."""
    return np.log1p(n) / (1 + np.log1p(runs / 400.0))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Chain:
    categories: list[str]
    #: per category: for each bin its coefficient; then intercept and the coefficients of earlier probabilities
    bins: list[np.ndarray]
    rest: list[np.ndarray]

    def logits(self, row, col, n, runs) -> np.ndarray:
        """(texts, categories) log odds, each fed to the next."""
        out = np.zeros((len(runs), len(self.categories)))
        v = _weight(n, runs[row])
        for k in range(len(self.categories)):
            z = np.bincount(row, weights=v * self.bins[k][col], minlength=len(runs)) + self.rest[k][0]
            out[:, k] = z + sigmoid(out[:, :k]) @ self.rest[k][1:]
        return out


def _logistic(x: np.ndarray, y: np.ndarray, use: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Ridge logistic regression on the rows in ``use``, with an intercept in column 0, by accelerated gradient steps."""
    y, use = y.astype(np.float32), use.astype(np.float32)
    n = np.float32(max(1, use.sum()))
    w = v = np.zeros(x.shape[1], np.float32)
    pen = np.full(x.shape[1], ridge, np.float32)
    pen[0] = 0
    u = np.ones(x.shape[1], np.float32)
    for _ in range(25):  # largest curvature, by power iteration, which comes near it from below
        u = ((x @ u) * use) @ x
        u /= np.linalg.norm(u) or 1
    rate = np.float32(1 / (0.3 * np.linalg.norm((x @ u) * use) ** 2 / n + ridge))
    for k in range(steps):
        g = ((sigmoid(x @ v) - y) * use).astype(np.float32) @ x / n + pen * v
        w, old = v - rate * g, w
        v = w + np.float32(k / (k + 3)) * (w - old)
    return w


def fit(labelled: DataFrame, categories: list[str], sample: int = SAMPLE, columns: int = COLUMNS) -> Chain:
    """A chain from rows of doc_id, text and one 0/1 column a category, in that order.

    Fitted on at most about ``sample`` rows, those with the smallest hash of (doc_id, text); rows
    with a null text or a null label teach nothing. Columns are chosen by counts that tasks sum
    up; of the sample only its values in the chosen columns reach the driver.
    """
    ok = F.col("text").isNotNull()
    for c in categories:
        ok = ok & F.col(c).isNotNull()
    names = [f"y{k}" for k in range(len(categories))]
    rows = labelled.where(ok).select("text", F.xxhash64("doc_id", "text").alias("key"), *[F.col(c).cast("int").alias(y) for c, y in zip(categories, names, strict=True)])
    total = rows.count()
    # a cut of the hash, so nothing is ordered or gathered; about ``sample`` rows pass
    some = cut(rows.where((F.col("key") / F.lit(2.0**64) + 0.5) <= min(1.0, sample / max(1, total))))
    sums = some.agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in names]).first()
    if not sums["n"]:
        return Chain(categories, [np.zeros(BINS)] * len(categories), [np.concatenate(([-20.0], np.zeros(k))) for k in range(len(categories))])
    used = _associated(_present(some, names), names, sums, columns)
    got = _features(some, names, used)
    fold = np.arange(len(got["key"])) % FOLDS
    earlier = np.zeros((len(fold), 0), np.float32)
    chain = Chain(categories, [], [])
    for k, y in enumerate(got[c] for c in names):
        if y.min() == y.max():  # one class only
            chain.bins.append(np.zeros(BINS))
            chain.rest.append(np.concatenate(([20.0 if y[0] else -20.0], np.zeros(k))))
            earlier = np.column_stack([earlier, y.astype(np.float32)])
            continue
        x = np.zeros((len(fold), 1 + k + len(used[k])), np.float32)
        x[:, 0] = 1
        x[:, 1 : 1 + k] = earlier
        for i, (col, value) in enumerate(zip(got["cols"], got["values"], strict=True)):
            at = np.searchsorted(used[k], col)
            hit = at < len(used[k])
            hit[hit] = used[k][at[hit]] == col[hit]
            x[i, 1 + k + at[hit]] = value[hit]
        w = _logistic(x, y, np.ones(len(fold), bool))
        bins = np.zeros(BINS)
        bins[used[k]] = w[1 + k :]
        chain.bins.append(bins)
        chain.rest.append(w[: 1 + k])
        if k + 1 < len(categories):
            out = np.zeros(len(fold), np.float32)
            for f in range(FOLDS):
                here = fold == f
                out[here] = (x @ _logistic(x, y, ~here))[here]
            earlier = np.column_stack([earlier, sigmoid(out)])
        del x
    return chain


def _present(some: DataFrame, names: list[str]) -> DataFrame:
    """(bin, n, one sum a category): in how many sample texts a bin occurs, and in how many of each category's; summed in tasks first."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros((1 + len(names), BINS), np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            labels = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            for lo, hi in _ranges(texts):
                row, col, _, _ = counts(texts[lo:hi])
                total[0] += np.bincount(col, minlength=BINS)
                for k, y in enumerate(labels):
                    total[1 + k] += np.bincount(col[y[lo:hi][row] == 1], minlength=BINS)
        bins = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(bins), *(pa.array(t[bins]) for t in total)], names=["bin", "n", *names])

    parts = some.mapInArrow(run, "bin long, n long, " + ", ".join(f"{c} long" for c in names))
    return parts.groupBy("bin").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])


def _associated(present: DataFrame, names: list[str], sums, columns: int) -> list[np.ndarray]:
    """For each category the bins whose presence is most associated with its label (signed root of the chi-square statistic)."""
    told, out = cut(present), []
    for c in names:
        p = sums[c] / sums["n"]
        score = F.abs(F.col(c) - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)) + 1e-9)
        best = told.where("n >= 3").select("bin", F.round(score, 9).alias("score")).where("score > 0").orderBy(F.desc("score"), "bin").limit(columns)
        out.append(np.sort(np.array([r["bin"] for r in best.collect()], np.int64)))  # ``columns`` rows
    return out


def _features(some: DataFrame, names: list[str], used: list[np.ndarray]) -> dict:
    """The sample in order of its hash: key, labels, and of each text the chosen bins and their values."""
    chosen = np.zeros(BINS, bool)
    for u in used:
        chosen[u] = True
    shared = some.sparkSession.sparkContext.broadcast(chosen)  # bounded: BINS bytes

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, cols, values = batch.column("text").to_pylist(), [], []
            for lo, hi in _ranges(texts):
                row, col, n, runs = counts(texts[lo:hi])
                keep = shared.value[col]
                v = _weight(n[keep], runs[row[keep]]).astype(np.float32)
                at = np.searchsorted(row[keep], np.arange(1, hi - lo))
                cols += [c.astype(np.int32).tobytes() for c in np.split(col[keep], at)]
                values += [x.tobytes() for x in np.split(v, at)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(batch.column(c) for c in names), pa.array(cols, pa.binary()), pa.array(values, pa.binary())], names=["key", *names, "cols", "values"])

    told = some.mapInArrow(run, "key long, " + ", ".join(f"{c} int" for c in names) + ", cols binary, values binary")
    got = sorted(((r["key"], *[r[c] for c in names], bytes(r["cols"]), bytes(r["values"])) for r in told.toLocalIterator()))
    out = {c: np.array([r[i] for r in got]) for i, c in enumerate(["key", *names])}
    return out | {"cols": [np.frombuffer(r[-2], np.int32) for r in got], "values": [np.frombuffer(r[-1], np.float32) for r in got]}


def predict(docs: DataFrame, chain: Chain, keep: list[str], names: list[str] | None = None) -> DataFrame:
    """``keep`` columns, unchanged, with a probability of every whole text for each category, p_<category> if not named otherwise; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # bounded: BINS floats a category
    names = names or [f"p_{c}" for c in chain.categories]
    (text,) = ("text",) if "text" in keep else fresh([*keep, *names], "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            got = [shared.value.logits(*counts(texts[lo:hi])) for lo, hi in _ranges(texts)]
            p = sigmoid(np.concatenate(got)) if got else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(np.ascontiguousarray(x)) for x in p.T)], names=[*keep, *names])

    kept = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").alias(text))
    return kept.mapInArrow(run, docs.select(*keep).withColumns({n: F.lit(0.0) for n in names}).schema)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with their categories; the chain runs from low quality to toxicity. Repeated labels of a document count once, the highest."""
    by = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l")).agg((1 - F.min("quality")).alias("low_quality"), F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(by, F.col("doc_id") == F.col("l"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Category probabilities of every document, and whether it is toxic.

    Defined cases: a null text counts as empty; documents without labels are predicted but
    teach nothing; without any labels nothing is toxic; repeated rows are each predicted; an
    empty table gives an empty result; other columns are ignored.

    Returns doc_id, p_low_quality, p_toxic, toxic.
    """
    chain = fit(labelled(docs, labels), ["low_quality", "toxic"])
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chain, ["doc_id"]).withColumn("toxic", F.col("p_toxic") >= threshold)
