"""Packing token sequences by Best-two-fit.

Texts become pieces of at most ``limit`` tokens; only (doc_id, place, length, checksum) rows
leave the tokenizing tasks. Pieces are dealt to groups of a bounded number of documents, and
each group is packed on its own, which costs at most one unfilled sequence a group.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Documents whose pieces are packed together.
GROUP_ROWS = 6000
BATCH_CHARS = 1 << 21
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The worker's encoder for a vocabulary file; workers keep it from task to task."""
    if path not in _encoders:
        from .tokens import WordBPE

        _encoders[path] = WordBPE(path)
    return _encoders[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, name: str = VOCABULARY, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document's ids and a last ``end_id``; longer documents are cut at multiples of ``limit``."""
    def run(batches):
        import pyarrow as pa

        encode = encoder(vocabulary_path(name)).encode_bytes
        end, step, seen = int(end_id).to_bytes(4, "little"), 4 * limit, 0
        for batch in batches:
            texts, ids = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id")
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= BATCH_CHARS):
                    chars += len(texts[hi])
                    hi += 1
                rows = []
                for i, own in enumerate(encode(texts[lo:hi]), lo):
                    own += end
                    rows += [(i, k // step, k // 4, min(step, len(own) - k) // 4, zlib.crc32(own[k : k + step]), seen) for k in range(0, len(own), step)]
                    seen += 1
                at, piece, start, length, crc, nth = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, nth))], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item.

    A bin takes the largest item that fits, again and again; then its smallest item makes way
    for two unpacked items, if two fit the widened gap more tightly than it did.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = np.flatnonzero(lengths >= limit)
    bins[full] = np.arange(len(full))
    waiting: dict[int, list[int]] = {}
    rest = np.flatnonzero(lengths < limit)
    for i in rest[::-1].tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)
    open_sizes = sum(1 << n for n in waiting)  # bit n: an unpacked item of length n
    largest = lambda most: (open_sizes & ((2 << most) - 1)).bit_length() - 1

    def take(n: int) -> int:
        nonlocal open_sizes
        i = waiting[n].pop()
        if not waiting[n]:
            del waiting[n]
            open_sizes ^= 1 << n
        return i

    nth = len(full)
    while open_sizes:
        gap, inside = limit, []
        while gap and (n := largest(gap)) >= 0:
            inside.append(take(n))
            gap -= n
        if gap and len(inside) > 1:
            small = int(lengths[inside[-1]])  # items were taken from the largest down
            room = gap + small
            best = (small, 0, 0)
            a = largest(room - 1)
            while a > 0 and 2 * a > best[0]:
                b = largest(min(a, room - a))
                if b == a and len(waiting[a]) < 2:
                    b = largest(a - 1)
                if b >= 0 and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = largest(a - 1) if a > 1 else -1
            if best[1]:
                waiting.setdefault(small, []).append(inside.pop())
                open_sizes |= 1 << small
                inside += [take(best[1]), take(best[2])]
        at = 0
        for i in inside:
            bins[i], offsets[i] = nth, at
            at += int(lengths[i])
        nth += 1
    return bins, offsets


def pack(docs: DataFrame, name: str = VOCABULARY, limit: int = LIMIT, end_id: int = END_ID, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every document's pieces, placed gaplessly in sequences of at most ``limit`` tokens.

    Defined cases: a null text is empty and has the one id ``end_id``; a null doc_id is kept;
    repeated rows are packed as often as they stand; an empty table gives an empty result;
    other columns are ignored. A third of all rows may be alike: groups are dealt by doc_id
    and the row's place in its input partition.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    groups = max(1, -(-docs.count() // group_rows))
    rows = pieces(docs, name, limit, end_id).withColumn("group", F.pmod(F.xxhash64("doc_id", "nth"), F.lit(groups)).cast("int"))

    def place(table):
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32", "nth")])
        bins, offsets = best_two_fit(table.column("length").to_numpy(), limit)
        kept = [table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.table([*kept, pa.array((table.column("group").to_numpy().astype(np.int64) << 32) + bins), pa.array(offsets)], names=[f.split()[0] for f in PLACES.split(", ")])

    return rows.groupBy("group").applyInArrow(place, PLACES)
