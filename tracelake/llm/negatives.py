"""Hard-negative mining by a secondary-sort shuffle.

For each anchor, the highest-scored rows of its own label are its positives; for each positive,
the highest-scored rows of other labels whose score lies in a band below the positive's are its
hard negatives. Scores are integer inner products.

Spark plan: vectors are dealt to blocks, and each pair of an anchor block and a row block is
scored by one matrix product in one task. A first pass over the pairs of one label gives the
positives. A second pass knows each anchor's bands, so a task hands on only what can be among
the first negatives of a band: a row block's best of each band, which loses nothing. What is handed
on are packed keys (anchor, descending score, positives before negatives, id): 25 bytes whose byte
order is the wanted order. Keys are dealt by anchor and sorted within partitions by their bytes;
an iterator reads each partition as a stream, opens a band at each positive and emits negatives as
they come. It holds an anchor's open bands (as many as positives), never an anchor's rows.

Every anchor meets every row, so the scoring grows with anchors times rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Anchors and rows of a block.
ANCHOR_BLOCK, ROW_BLOCK = 4096, 4096
#: Anchors of a block that are scored in one matrix product.
AT_ONCE = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1
POSITIVE, NEGATIVE = 0, 1


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, anchors x rows; results beyond 64 bits are set to the nearest 64-bit integer."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    # of absolute values, as Python integers: the least 64-bit integer has no positive one
    bound = max(abs(int(anchors.min())), int(anchors.max())) * max(abs(int(rows.min())), int(rows.max())) * anchors.shape[1]
    if bound < 1 << 53:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    if bound < 1 << 63:
        return anchors @ rows.T
    return np.clip(anchors.astype(object) @ rows.astype(object).T, LEAST, MOST).astype(np.int64)


def pack(anchor: int, score: int, kind: int, row: int) -> bytes:
    """A key that sorts by anchor, then descending score, then kind, then row."""
    return struct.pack(">QQBQ", anchor - LEAST, MOST - score, kind, row - LEAST)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = struct.unpack(">QQBQ", key)
    return anchor + LEAST, MOST - score, kind, row + LEAST


def band(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score whose hundredfold lies between low and high times a positive's."""
    return -(-low * positive // 100), high * positive // 100


def stream(keys: Iterable[bytes], negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive's score, negative's score) from sorted keys.

    A positive opens a band; a negative fills each open band that it fits; a band that is
    full or lies above the current score is closed.
    """
    anchor, bands = None, []
    for key in keys:
        a, score, kind, row = unpack(key)
        if a != anchor:
            anchor, bands = a, []
        if kind == POSITIVE:
            bands.append([*band(score, low, high), row, score, 0])
            continue
        for b in bands:
            if b[0] <= score <= b[1]:
                b[4] += 1
                yield a, b[2], b[4], row, b[3], score
        bands = [b for b in bands if b[4] < negatives and b[0] <= score]


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id; ids ascend."""
    if len(score) > k:
        line = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > line)
        pick = np.concatenate([above, np.flatnonzero(score == line)[: k - len(above)]])
    else:
        pick = np.arange(len(score))
    return pick[np.lexsort((ids[pick], -score[pick].astype(object) if len(pick) and score[pick].min() == LEAST else -score[pick]))]


def _matrix(column, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)


def _spread(count: Column, seed: int) -> Column:
    """A row's block of ``count``."""
    return F.pmod(F.xxhash64("vec_id", F.lit(seed)), count).cast("int")


def _blocks(size: Column, block: int) -> Column:
    return F.greatest(F.ceil(size / F.lit(block)), F.lit(1)).cast("int")


def _pairs(anchors: DataFrame, rows: DataFrame, keys: list[str], anchor_block: int, row_block: int):
    """Both sides dealt to pairs of blocks within ``keys``: each row to one block of its side and all of the other's."""
    count = lambda side, name: side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    sizes = count(anchors, "na__").join(count(rows, "nr__"), keys)  # one row a key, of keys that have both
    sizes = sizes.select(*keys, _blocks(F.col("na__"), anchor_block).alias("na__"), _blocks(F.col("nr__"), row_block).alias("nr__"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(sizes, keys).withColumns({"ab__": _spread(F.col("na__"), 1), "rb__": every("nr__")}).drop("na__", "nr__")
    right = rows.join(sizes, keys).withColumns({"rb__": _spread(F.col("nr__"), 2), "ab__": every("na__")}).drop("na__", "nr__")
    by = [*keys, "ab__", "rb__"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both come from the same rows: columns of their own
    return left.groupBy(*by).cogroup(right.groupBy(*by))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """Hard negatives of ``vectors`` (vec_id, label, embedding of integers) for the rows of ``is_anchor``.

    An anchor's positives are its ``positives`` best other rows of its label; each has the
    ``negatives`` best rows of other labels with low * positive <= 100 * negative <= high * positive.
    Best is the highest score, then the smallest vec_id.

    Defined cases: rows with a null vec_id, label or vector or a null component take no part; rows
    that share a vec_id are one row, the least by label and components; vectors of different lengths
    never meet; the empty vectors score 0 with each other; components and scores beyond 64 bits
    count as the nearest 64-bit integer; fewer positives or negatives give fewer rows, and a positive
    of negative score none; an empty table gives an empty result; other columns are ignored.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    v = F.col("embedding").cast("array<long>")
    told = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    told = told.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    rows = told.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one")).select("vec_id", "one.*").withColumn("d", F.size("v"))
    rows = cut(rows)
    anchors = rows.where(is_anchor)

    def positives_of(a, r):
        import pyarrow as pa

        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and r.num_rows:
            r = r.sort_by("vec_id")
            ids, a_ids = r.column("vec_id").to_numpy(), a.column("vec_id").to_numpy()
            x, y = _matrix(a.column("v"), len(a_ids)), _matrix(r.column("v"), len(ids))
            for lo in range(0, len(a_ids), AT_ONCE):
                for anchor, score in zip(a_ids[lo : lo + AT_ONCE], scores(x[lo : lo + AT_ONCE], y), strict=True):
                    other = np.flatnonzero(ids != anchor)
                    pick = other[_first(score[other], ids[other], positives)]
                    out[0].append(np.full(len(pick), anchor))
                    out[1].append(score[pick])
                    out[2].append(ids[pick])
        return pa.table([pa.array(np.concatenate(o) if o else [], pa.int64()) for o in out], names=["anchor_id", "score", "row_id"])

    found = _pairs(anchors, rows, ["d", "label"], anchor_block, row_block).applyInArrow(positives_of, "anchor_id long, score long, row_id long")
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "row_id"))
    best = found.withColumn("nth", nth).where(F.col("nth") <= positives)
    known = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("score"), F.col("row_id")))).alias("best"))  # at most ``positives`` entries
    ready = cut(anchors.join(known.withColumnRenamed("anchor_id", "vec_id"), "vec_id"))

    def negatives_of(a, r):
        import pyarrow as pa

        keys: list[bytes] = []
        if a.num_rows and r.num_rows:
            r = r.sort_by("vec_id")
            ids, a_ids = r.column("vec_id").to_numpy(), a.column("vec_id").to_numpy()
            labels, a_labels = r.column("label").to_numpy(), a.column("label").to_numpy()
            bests = a.column("best").to_pylist()
            x, y = _matrix(a.column("v"), len(a_ids)), _matrix(r.column("v"), len(ids))
            for lo in range(0, len(a_ids), AT_ONCE):
                for i, score in enumerate(scores(x[lo : lo + AT_ONCE], y), lo):
                    strange = labels != a_labels[i]
                    pick: set[int] = set()
                    for b in bests[i]:
                        least, most = band(b["score"], low, high)
                        fits = np.flatnonzero(strange & (score >= max(least, LEAST)) & (score <= min(most, MOST)))
                        pick.update(fits[_first(score[fits], ids[fits], negatives)].tolist())
                    keys += [pack(int(a_ids[i]), int(score[p]), NEGATIVE, int(ids[p])) for p in pick]
        return pa.table([pa.array(keys, pa.binary())], names=["key"])

    met = _pairs(ready, rows, ["d"], anchor_block, row_block).applyInArrow(negatives_of, "key binary")

    def opening(batches):
        import pyarrow as pa

        for batch in batches:
            keys = [pack(a, b["score"], POSITIVE, b["row_id"]) for a, best in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for b in best]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    opened = ready.select("vec_id", "best").mapInArrow(opening, "key binary")
    # the DataFrame form of repartitionAndSortWithinPartitions: dealt by the key's anchor, sorted by the whole key
    dealt = opened.unionByName(met).repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")

    def emit(batches):
        import pyarrow as pa

        kinds = [("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())]

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

        out = []
        for row in stream((k for b in batches for k in b.column(0).to_pylist()), negatives, low, high):
            out.append(row)
            if len(out) >= 8192:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    return dealt.mapInArrow(emit, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null for a null vector and for one with a null or non-finite component."""
    v = embedding.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(v, lambda x: F.floor(x * scale)))
