"""Maximum inner product search with score-aware (anisotropic) product quantisation.

Vectors are coded as four-bit codewords, two dimensions a codeword. Codewords and codes
minimise a loss that weighs the part of the residual parallel to the vector more than the
rest, because that part is what moves large inner products. A query scans a block of codes by
table lookups (two codewords a byte-wide table). The RERANK best of the scan are scored on their
vectors, which gives a line that the block's k best reach. What a code leaves out of a row is a
residual of known length, so a row's score exceeds its scanned one by at most that length times
the query's: every row that could reach the line is scored on its vector, in single precision
with its error bounded, and those that may be among the k best once more in double precision.
So the result is exact on any vectors, also where many share a code; codes that tell rows apart
badly cost time, not rows.

Spark plan: codes and vectors are dealt to blocks of bounded size, queries to bounded blocks too;
each pair of blocks is one co-group task, so neither side is broadcast and memory stays bounded
however many rows there are. A block hands on a query's k best rows. Every query meets every code:
the scan's work grows with queries times rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the fitting sample, candidates a block, queries a block.
SAMPLE, BLOCK, QUERY_BLOCK = 8192, 65_536, 2048
#: The loss treats inner products above this share of the vector's length as those that matter.
THRESHOLD = 0.2
SUBDIM, CODES, ROUNDS = 2, 16, 4
#: Candidates of a block that are scored first for each query, best scanned scores first.
RERANK = 320
#: Beyond what float32 loses of products near zero, for vectors of components below 1.
TINY = 1e-30


@dataclass
class Codebook:
    centers: np.ndarray  # subspaces x CODES x SUBDIM
    eta: float

    def parts(self, x: np.ndarray) -> np.ndarray:
        m = len(self.centers)
        wide = np.zeros((len(x), m * SUBDIM))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), m, SUBDIM)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, one subspace after another."""
        p = self.parts(x)
        unit = p / np.maximum(np.sqrt((p**2).sum((1, 2), keepdims=True)), 1e-300)
        error = p[:, :, None, :] - self.centers[None]  # rows x subspaces x codes x dims
        square, along = (error**2).sum(3), (error * unit[:, :, None, :]).sum(3)
        codes = square.argmin(2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for m in range(p.shape[1]):
                rest = total - along[rows, m, codes[:, m]]
                cost = square[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2
                codes[:, m] = cost.argmin(1)
                total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)


    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centers[np.arange(len(self.centers)), codes].reshape(len(codes), -1)

    def reach(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For each row, by how much its inner product with a query of length 1 may exceed what scan() gives, float32 sums included."""
        back = self.decode(codes)
        rest = self.parts(x).reshape(len(x), -1) - back
        return np.sqrt((rest**2).sum(1)) * (1 + 1e-5) + single(len(self.centers)) * np.sqrt((back**2).sum(1)) + TINY


def single(terms: int) -> float:
    """Error bound of an inner product of so many terms in float32, as a share of the product of lengths."""
    return (terms + 16) * 2.0**-23


def fit_codebook(x: np.ndarray, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> Codebook:
    """Codewords for a sample: k-means a subspace, then alternating codes and least squares under the anisotropic loss."""
    n, d = x.shape
    m = -(-d // SUBDIM)
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    book = Codebook(np.zeros((m, CODES, SUBDIM)), eta)
    p = book.parts(x)
    rng = np.random.default_rng(7)
    for s in range(m):
        c = p[rng.choice(n, CODES, replace=n < CODES), s]
        for _ in range(8):
            near = ((p[:, s, None, :] - c[None]) ** 2).sum(2).argmin(1)
            for k in range(CODES):
                if (near == k).any():
                    c[k] = p[near == k, s].mean(0)
        book.centers[s] = c
    unit = (p / np.maximum(np.sqrt((p**2).sum((1, 2), keepdims=True)), 1e-300)).reshape(n, -1)
    flat, size = p.reshape(n, -1), m * CODES * SUBDIM
    for _ in range(rounds):
        codes = book.encode(x).astype(np.int64)
        at = ((np.arange(m) * CODES + codes)[:, :, None] * SUBDIM + np.arange(SUBDIM)).reshape(n, -1)
        # normal equations of sum ||e||^2 + (eta - 1) (u . e)^2 over all codewords at once
        gram, right = np.diag(np.bincount(at.ravel(), minlength=size) + 1e-6), np.bincount(at.ravel(), flat.ravel(), size)
        for lo in range(0, n, 1024):
            v = np.zeros((min(1024, n - lo), size), np.float32)
            np.put_along_axis(v, at[lo : lo + 1024], unit[lo : lo + 1024].astype(np.float32), 1)
            gram += (eta - 1) * (v.T @ v)
            right += (eta - 1) * (v.T @ (unit[lo : lo + 1024] * flat[lo : lo + 1024]).sum(1).astype(np.float32))
        right += 1e-6 * book.centers.ravel()
        book.centers = np.linalg.solve(gram, right).reshape(m, CODES, SUBDIM)
    return book


def scan(book: Codebook, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Approximate inner products, queries x rows, by lookups of byte-wide tables that join two four-bit codes."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    pairs = np.ascontiguousarray((codes[:, 0::2].astype(np.int64) * CODES + codes[:, 1::2]).T)
    tables = np.einsum("qmd,mkd->qmk", book.parts(queries), book.centers).astype(np.float32)
    if tables.shape[1] % 2:
        tables = np.concatenate([tables, np.zeros((len(tables), 1, CODES), np.float32)], 1)
    wide = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, CODES * CODES)
    out = np.zeros((len(queries), codes.shape[0]), np.float32)
    for q in range(len(queries)):
        row = out[q]
        for m in range(len(pairs)):
            row += wide[q, m].take(pairs[m])
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: no null, no null or non-finite component, not zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def search(vectors: DataFrame, is_query, k: int = 20, rerank: int = RERANK, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query row's ``k`` nearest other rows by inner product.

    Defined cases: rows that usable() drops are neither queries nor candidates; vectors of
    different lengths are searched apart; rows
    that share a vec_id are one row, the first by components; ties go to the smaller vec_id;
    fewer than ``k`` candidates give fewer rows; an empty table gives an empty result; other
    columns are ignored.

    Returns query_id, rank, vec_id, score.
    """
    rows = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("d", F.size("embedding"))
    largest = F.max(F.array_max(F.transform("embedding", F.abs)))
    sizes = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), largest.alias("largest")).orderBy(F.desc("n")).collect()  # one row a length
    single_ = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    out = [_search(rows.where(F.col("d") == r["d"]).drop("d"), r["n"], r["largest"], single_, is_query, k, rerank, block, query_block) for r in sizes]
    if not out:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    whole = out[0]
    for other in out[1:]:
        whole = whole.unionByName(other)
    return whole


def _kth(x: np.ndarray, k: int) -> np.float32:
    """The k-th largest value, a float32 step lower; minus infinity if there are fewer."""
    return np.nextafter(np.partition(x, len(x) - k)[len(x) - k].astype(np.float32), np.float32(-np.inf)) if len(x) >= k else np.float32(-np.inf)


def _search(rows: DataFrame, n: int, largest: float, single_: bool, is_query, k: int, rerank: int, block: int, query_block: int) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    key = F.xxhash64("vec_id")
    # rows are coded and scanned as multiples of a power of two beyond all components, so that float32 holds their products
    power = -int(np.frexp(largest)[1])
    kind = np.float32 if single_ else np.float64  # vectors travel as they were given
    near = rows.where((key / F.lit(2.0**64) + 0.5) <= 1.2 * SAMPLE / n).orderBy(key).limit(SAMPLE)
    sample = _matrix([r["embedding"] for r in near.collect()] or [rows.first()["embedding"]])  # at most SAMPLE vectors
    book = sc.broadcast(fit_codebook(np.ldexp(sample, power)))  # bounded: dimensions x CODES doubles

    def encode(parts):
        for pdf in parts:
            if len(pdf):
                x = _matrix(pdf["embedding"])
                low = np.ldexp(x, power)
                codes = book.value.encode(low)
                yield pdf[["vec_id"]].assign(code=[c.tobytes() for c in codes], vector=[v.tobytes() for v in x.astype(kind)], reach=book.value.reach(low, codes))

    index = rows.mapInPandas(encode, "vec_id long, code binary, vector binary, reach double")
    queries = rows.where(is_query)
    n_queries = queries.count()
    blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    spread = lambda count, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("vec_id", "embedding", spread(q_blocks, 1).alias("qb"), every(blocks).alias("cb"))
    right = index.select("vec_id", "code", "vector", "reach", spread(blocks, 2).alias("cb"), every(q_blocks).alias("qb"))

    def near_in_block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        c = c.sort_values("vec_id")
        ids, reach = c["vec_id"].to_numpy(), c["reach"].to_numpy().astype(np.float32)
        codes = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1)
        x = np.frombuffer(b"".join(c["vector"]), kind).reshape(len(c), -1)
        low = np.ldexp(x.astype(float), power)
        unsure = (single(x.shape[1]) * np.sqrt((low**2).sum(1)) + TINY).astype(np.float32)
        low = low.astype(np.float32)
        q_ids, y = q["vec_id"].to_numpy(), _matrix(q["embedding"])
        # a query's own scale doesn't change its order
        wanted = np.ldexp(y, -np.frexp(np.abs(y).max(1, keepdims=True))[1])
        lengths = np.sqrt((wanted**2).sum(1)).astype(np.float32)
        own = np.searchsorted(ids, q_ids)
        own[own == len(ids)] = 0
        own[ids[own] != q_ids] = -1
        most, found = min(max(rerank, k), len(c)), []
        for at in range(0, len(q), 64):
            rough = scan(book.value, codes, wanted[at : at + 64])
            for i, scanned in enumerate(rough, at):
                query = wanted[i].astype(np.float32)

                def within(some, query=query, i=i):
                    some = some[some != own[i]]
                    return some, low[some] @ query, lengths[i] * unsure[some]

                if own[i] >= 0:
                    scanned[own[i]] = -np.inf
                _, score, error = within(np.argpartition(scanned, len(c) - most)[len(c) - most :])
                some, score, error = within(np.flatnonzero(scanned + lengths[i] * reach >= _kth(score - error, k)))
                some = some[score + error >= _kth(score - error, k)]
                # components are multiplied and added one after the other, so equal vectors have equal scores
                exact = np.cumsum(x[some].astype(float) * y[i], 1)[:, -1] + 0.0
                best = np.lexsort((ids[some], -exact))[:k]
                found.append((np.full(len(best), q_ids[i]), ids[some[best]], exact[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    near = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(near_in_block, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
