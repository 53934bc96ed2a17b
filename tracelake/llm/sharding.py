"""K-d tree sharding: documents into byte-balanced shards by metadata ranges.

Spark plan: one scan of the documents writes a small metadata table (no text), all further
passes read that table. A tree level costs a few aggregations whose results are bounded by
constants (open nodes x 4096 histogram buckets), so the driver never sees rows that grow
with the corpus. Splits land in a nested CASE, which assigns shards without a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import case_tree, cut

#: A split key has 24 bits of the metadata value, then 24 bits of a text hash and 12 of a row hash that break ties.
VALUE_BITS, TEXT_BITS, ROW_BITS, STEP_BITS = 24, 24, 12, 12
TIE_BITS = TEXT_BITS + ROW_BITS
#: A cut goes through the rows of one text only if they have more than this fraction of a shard's bytes.
WHOLE = 10
#: A cut is close enough if its bucket has at most this fraction of a shard's bytes.
CLOSE = 1000


def kd_shards(docs: DataFrame, shards: int = 40, rows_per_slot_group: int = 1000) -> DataFrame:
    """Split ``docs`` into ``shards`` leaves of near-equal bytes.

    A node with k leaves is cut along its widest metadata dimension (log size, language,
    source; spread relative to the whole corpus) at the weighted quantile floor(k/2)/k of its
    bytes, until every node is one leaf. A row weighs its UTF-8 bytes plus 16.

    Rows of equal texts are one group: its least language and source count for all of them, and
    equal metadata values are cut between text hashes. Only a group with more than 1/WHOLE of a
    shard's bytes may be divided, by a hash of its rows, because near-equal bytes come first.

    Defined cases: null text has 16 bytes and checksum 0; null language or source is a value
    of its own; a null doc_id is kept; repeated rows are all placed; an empty table gives an
    empty result. Columns beyond doc_id, text, lang and source are ignored.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    unit = lambda c: (F.xxhash64(F.coalesce(F.col(c), F.lit("\x00")).cast("string")).bitwiseAND(F.lit((1 << VALUE_BITS) - 1)))
    size = F.octet_length(text).cast("long") + F.lit(16)
    low = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1))
    # log2 of a size in bytes is below 64, so a fixed scale serves every corpus
    log_size = F.floor(F.log2(size.cast("double")) * F.lit((1 << (VALUE_BITS - 6)) - 1)).cast("long")
    plain = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th"), low(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), text), ROW_BITS).alias("row"), log_size.alias("d0"), unit("lang").alias("d1"), unit("source").alias("d2")))
    copies = plain.groupBy("th").agg(F.count(F.lit(1)).alias("n"), F.min("d1").alias("m1"), F.min("d2").alias("m2")).where("n > 1").drop("n")
    tie = F.shiftleft(low(F.col("th"), TEXT_BITS), ROW_BITS).bitwiseOR(F.col("row"))
    key = lambda v: F.shiftleft(v, TIE_BITS).bitwiseOR(tie)
    meta = plain.join(copies, "th", "left").select("doc_id", "size", "text_crc32", tie.alias("tie"), key(F.col("d0")).alias("k0"), key(F.coalesce("m1", "d1")).alias("k1"), key(F.coalesce("m2", "d2")).alias("k2"))
    meta = cut(meta)

    total, rows, tree = _grow(meta, shards)
    shard = case_tree(tree, lambda leaf: F.lit(leaf), lambda cut_at: F.col(f"k{cut_at[0]}") < F.lit(cut_at[1]))
    groups = max(1, -(-rows // (shards * rows_per_slot_group)))
    placed = meta.withColumn("shard", shard.cast("int")).withColumn("part", F.pmod(F.xxhash64("tie", "doc_id"), F.lit(groups)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "tie", "size")
    return (
        placed.withColumn("rank", F.row_number().over(inside))
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def _grow(meta: DataFrame, shards: int):
    """(bytes, rows, tree): the tree's inner nodes are ((dimension, cut key), left, right), leaves are shard numbers."""
    dims = range(3)
    first = meta.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *[f(F.shiftright(f"k{d}", TIE_BITS)).alias(f"{s}{d}") for d in dims for s, f in (("lo", F.min), ("hi", F.max))]).first()
    rows = first["n"]
    if not rows:
        return 0, 0, 0
    spread = [max(1, first[f"hi{d}"] - first[f"lo{d}"]) for d in dims]
    # a node is [path, first leaf, leaves]; splits[path] = (dimension, cut)
    splits: dict[str, tuple[int, int]] = {}
    level = [("", 0, shards)]
    leaf_of = {}
    while level:
        for path, at, k in level:
            if k == 1:
                leaf_of[path] = at
        level = [x for x in level if x[2] > 1]
        if not level:
            break
        ids = {path: i for i, (path, _, _) in enumerate(level)}

        def build(path: str):
            return ((splits[path]), build(path + "0"), build(path + "1")) if path in splits else ids.get(path, -1)

        node = case_tree(build(""), lambda i: F.lit(i), lambda c: F.col(f"k{c[0]}") < F.lit(c[1]))
        # rows of finished leaves have node -1: one more group each time, dropped here; a filter would repeat the CASE
        open_rows = meta.select("size", "k0", "k1", "k2", node.alias("node"))
        seen = {r["node"]: r for r in open_rows.groupBy("node").agg(F.sum("size").alias("w"), *[f(F.shiftright(f"k{d}", TIE_BITS)).alias(f"{s}{d}") for d in dims for s, f in (("lo", F.min), ("hi", F.max))]).collect()}
        widest = {i: max(dims, key=lambda d: ((seen[i][f"hi{d}"] - seen[i][f"lo{d}"]) / spread[d], -d)) if i in seen else 0 for i in ids.values()}
        wanted = {i: (seen[i]["w"] if i in seen else 0) * (k // 2) / k for (_, _, k), i in zip(level, ids.values(), strict=True)}
        prefix, below, last = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0)
        shift = VALUE_BITS + TIE_BITS
        at_shift, coarse = dict.fromkeys(wanted, shift), set(wanted)
        # 12 bits of the keys a round, until the bucket in which a cut falls is small beside a shard
        while shift and coarse:
            bucket = F.lit(None).cast("long")
            for i in coarse:
                key_i = F.col(f"k{widest[i]}")
                bucket = F.when((F.col("node") == i) & (F.shiftright(key_i, shift) == prefix[i]), F.shiftright(key_i, shift - STEP_BITS)).otherwise(bucket)
            shift -= STEP_BITS
            hist: dict[int, list[tuple[int, int]]] = {}
            for r in open_rows.select("node", "size", bucket.alias("b")).groupBy("node", "b").agg(F.sum("size").alias("w")).collect():
                if r["b"] is not None:
                    hist.setdefault(r["node"], []).append((r["b"], r["w"]))
            for i in coarse:
                prefix[i], below[i] = _bucket(sorted(hist.get(i, [])), wanted[i], below[i], prefix[i] << STEP_BITS)
                last[i], at_shift[i] = dict(hist.get(i, [])).get(prefix[i], 0), shift
            # a bucket of one text stays whole unless it is a good part of a shard
            coarse = {i for i in coarse if last[i] * shards * (WHOLE if shift <= ROW_BITS else CLOSE) > first["w"]}
        for path, i in ids.items():
            # the cut goes to whichever edge of the last bucket is nearer to the wanted weight
            upper = abs(below[i] + last[i] - wanted[i]) < abs(below[i] - wanted[i])
            splits[path] = (widest[i], (prefix[i] + upper) << at_shift[i])
        level = [y for path, at, k in level for y in ((path + "0", at, k // 2), (path + "1", at + k // 2, k - k // 2))]

    def final(path: str):
        return (splits[path], final(path + "0"), final(path + "1")) if path in splits else leaf_of[path]

    return first["w"], rows, final("")


def _bucket(hist, wanted: float, below: int, default: int) -> tuple[int, int]:
    """The bucket in which the running weight reaches ``wanted``, and the weight before it."""
    for b, w in hist:
        if below + w >= wanted:
            return b, below
        below += w
    return (hist[-1][0], below - hist[-1][1]) if hist else (default, below)

