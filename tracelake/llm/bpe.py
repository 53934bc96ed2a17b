"""BPE encoding by contiguous rank arrays, and decoding.

A short word is held as one row of three arrays: where its parts begin (``bounds``), the parts'
ids, and the rank of merging each part with its right neighbour. Again and again the row is
scanned for its lowest rank, the boundary between those two parts is deleted, what stands right of
it moves one place left, and the ranks of the two neighbouring pairs are looked up anew. Many words
take these steps together, as array operations; equal words of a batch are encoded once. In words of
over SHORT bytes a scan a merge would cost the square of the length: these take the same merges
from a heap.

Normalising and splitting follow the vocabulary file (tokens.WordBPE); the tokenizer library judges
texts with special tokens and letters on which Unicode versions may differ.

Each row is encoded by itself, in batches of bounded size, without a shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .packing import BATCH_CHARS, VOCABULARY, vocabulary_path
from .tokens import WordBPE

#: Longest words, in bytes, that are merged by scanning; widths of the arrays that hold them.
WIDTHS = (8, 16, 32, 64)
SHORT = WIDTHS[-1]
#: Rank of two parts that no merge joins.
NEVER = np.int32(1 << 30)


class RankArrayBPE(WordBPE):
    """Encoder and decoder of a vocabulary file."""

    def __init__(self, path: str):
        super().__init__(path)
        names = self.library.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        used = self.keys >= 0
        self.merges = dict(zip(self.keys[used].tolist(), zip(self.ranks[used].tolist(), self.made[used].tolist(), strict=True), strict=True))

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [r.encode("utf-8") for r in runs]
        out = [b""] * len(raw)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        least = 0
        for width in WIDTHS:
            pick = np.flatnonzero((sizes > least) & (sizes <= width))
            if len(pick):
                for i, ids in zip(pick, self._scan([raw[i] for i in pick], width), strict=True):
                    out[i] = ids
            least = width
        for i in np.flatnonzero(sizes > SHORT):
            out[i] = self._heap(raw[i])
        return out

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id of the merged part) of neighbouring parts."""
        rank, slot = self._lookup(left * (1 << 17) + right)
        return rank, self.made[slot]

    def _scan(self, words: list[bytes], width: int) -> list[bytes]:
        n, columns = len(words), np.arange(width + 1)
        size = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(w.ljust(width + 1, b"\0") for w in words), np.uint8).reshape(n, width + 1)
        # part k of a row is [bounds[k], bounds[k + 1]) while bounds[k] < size; ranks[k] is that of parts k and k + 1
        bounds = np.minimum(columns, size[:, None])
        parts = self.first[text]
        parts[np.arange(n), size - 1] = self.last[text[np.arange(n), size - 1]]
        ranks = np.full((n, width + 1), NEVER, np.int32)
        pairs = columns[None, :-1] < size[:, None] - 1
        ranks[:, :-1][pairs] = self._pair(parts[:, :-1][pairs], parts[:, 1:][pairs])[0]
        live = np.flatnonzero(size > 1)
        while len(live):
            at = ranks[live].argmin(1)
            some = ranks[live, at] < NEVER
            live, at = live[some], at[some]
            if not len(live):
                break
            parts[live, at] = self._pair(parts[live, at], parts[live, at + 1])[1]
            # without the boundary at + 1, all that stands right of it moves one place left; the last column is never a part
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width)
            for table in (bounds, parts, ranks):
                table[live] = np.take_along_axis(table[live], source, 1)
            for k in (at - 1, at):
                inside = k >= 0
                row, k = live[inside], k[inside]
                right = bounds[row, np.minimum(k + 1, width)] < size[row]
                ranks[row[~right], k[~right]] = NEVER
                row, k = row[right], k[right]
                ranks[row, k] = self._pair(parts[row, k], parts[row, k + 1])[0]
        held = bounds < size[:, None]
        flat = parts[held].astype("<u4").tobytes()
        ends = np.cumsum(held.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _heap(self, word: bytes) -> bytes:
        """The same merges for one long word: pairs wait in a heap by (rank, place), stale ones are passed over."""
        parts = self.first[np.frombuffer(word, np.uint8)].tolist()
        parts[-1] = int(self.last[word[-1]])
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]

        def pair(a: int, b: int) -> tuple[int, int]:
            return self.merges.get(a * (1 << 17) + b, (int(NEVER), -1))

        waiting = [(pair(parts[i], parts[i + 1])[0], i, parts[i], parts[i + 1]) for i in range(len(parts) - 1)]
        waiting = [w for w in waiting if w[0] < NEVER]
        heapq.heapify(waiting)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = pair(a, b)[1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (rank := pair(parts[left], parts[right])[0]) < NEVER:
                    heapq.heappush(waiting, (rank, left, parts[left], parts[right]))
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: a vocabulary without a decoder gives its entries, with a blank between two; unknown ids give nothing."""
        names = self.names
        return " ".join([names[i] for i in ids if 0 <= i < len(names)])


_coders: dict[str, RankArrayBPE] = {}


def coder(name: str = VOCABULARY) -> RankArrayBPE:
    """The worker's coder of a vocabulary; workers keep it from task to task."""
    if name not in _coders:
        _coders[name] = RankArrayBPE(vocabulary_path(name))
    return _coders[name]


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of some BATCH_CHARS code points, one text at least."""
    lo = chars = 0
    for i, t in enumerate(texts):
        if i > lo and chars + len(t) > BATCH_CHARS:
            yield lo, i
            lo, chars = i, 0
        chars += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _by_text(docs: DataFrame, text: str, add: str, rows: Callable, name: str) -> DataFrame:
    """All columns of ``docs`` and those of ``add``, which ``rows(coder, texts)`` makes for some texts."""
    width = len(docs.columns)
    own = fresh(docs.columns, *[c.split(" ")[0] for c in add.split(", ")])
    kinds = [c.split(" ", 1)[1] for c in add.split(", ")]
    # columns travel by place: names may hold dots or differ by case only
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)] + [f"a{i} {k}" for i, k in enumerate(kinds)])
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        code = coder(name)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for lo, hi in _portions(texts):
                made = rows(code, texts[lo:hi])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *made], names=[f"c{i}" for i in range(width)] + [f"a{i}" for i in range(len(made))])

    return docs.toDF(*[f"c{i}" for i in range(width)]).mapInArrow(run, schema).toDF(*docs.columns, *own)


def encode(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """``docs`` and the ids of each whole text, without ids at its ends, as column ``ids`` (array of int).

    Defined cases: a null or empty text has no ids; rows of any doc_id, null and repeated ones too,
    are encoded one by one; an empty table stays empty; columns of any name are handed on, and an
    own column called ``ids`` stays, the new one then being ``ids_``.
    """
    def rows(code: RankArrayBPE, texts: list[str]):
        import pyarrow as pa

        raw = code.encode_bytes(texts)
        ends = np.cumsum([0] + [len(b) // 4 for b in raw])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))]

    return _by_text(docs, "text", "ids array<int>", rows, name)


def decode(coded: DataFrame, ids: str = "ids", name: str = VOCABULARY) -> DataFrame:
    """``coded`` and the text that its ids decode to, special tokens included, as column ``decoded``; null ids decode to the empty text."""
    text = F.pandas_udf(lambda s: s.map(lambda v: coder(name).decode([] if v is None else v)), "string")
    own, = fresh(coded.columns, "decoded")
    return coded.withColumn(own, text(F.col(f"`{ids}`")))


def digests(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, a blank between two) and decoded_sha256 (of the decoded text) of each row, as encode() and decode() give them."""
    def rows(code: RankArrayBPE, texts: list[str]):
        import pyarrow as pa

        counts, coded, decoded = [], [], []
        for raw in code.encode_bytes(texts):
            ids = np.frombuffer(raw, "<u4").tolist()
            counts.append(len(ids))
            coded.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(code.decode(ids).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _by_text(told, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", rows, name).drop("text")
