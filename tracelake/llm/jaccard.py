"""Exact n-gram Jaccard join with signature trees.

1. One pass turns every whole text into its set of 5-word shingle hashes and keeps a 64-bit
   name, the size and a token bitmap of each; texts with equal sets are one class. The pass
   also counts tokens in a table of 2**20 counters.
2. Two sets of similarity t or more share a token among the first n - ceil(t n) + 1 of any
   common token order. The order puts frequent tokens last, so a passage that many documents
   share is in few prefixes. A second pass deals prefix tokens by token. The first token that two
   sets share leaves them no more in common than what stands behind it in either, so a holder
   that no other holder's size and place allow is left out. Tokens with one and the same holders
   are one group, and tokens of a single holder are dropped. The holders of a very frequent
   token are dealt to several blocks while they are being shuffled, and all stay.
3. Each block of a group is searched by a signature tree: nodes hold the OR of their members'
   bitmaps and their size range, and a dual traversal drops node pairs whose largest possible
   overlap is too small or whose members are joined already. What is left are candidate links;
   their components (clusters) hold every true link. Blocks of one group meet as nodes of a
   table, pruned in the same way, unless all their members are in one cluster already.
4. A cluster's texts are fetched once and its tree is searched again, now with the exact check
   of each candidate. A cluster too large for a task is dealt to blocks anew, twice, and then
   block pairs meet that still hold several components.

So a set goes to one cluster, copies are compared once, and a group of thousands of near copies
costs a few checks a member: pairs that are joined already aren't visited. Links inside a
component are therefore not enumerated. Sets, tokens and texts are named by 64-bit hashes; at
10**9 documents a false equality is expected once in some 20 corpora.
"""

from __future__ import annotations

import ctypes
import gc
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release
from .textbytes import chunks, flat, mix, shingle_sets

#: Similarity as a fraction of integers: 75 / 100.
SHARE, OF = 75, 100
SKETCH_BITS, SLICE_BITS, FAN_IN = 20, 14, 64
#: Prefix tokens in a task's part; more holders of one token are divided.
ENTRIES_PER_PART, HOT_ENTRIES = 250_000, 100_000
#: Members of a tree that one task searches, and rows of a task call that takes several.
GROUP_ROWS, BUNDLE_ROWS = 2000, 4000
#: Tokens of a cluster that one task checks exactly, and of the clusters of a task call that takes several.
BLOCK_TOKENS, BUNDLE_TOKENS = 4_000_000, 1_000_000
#: Bits of the table that tells which texts are fetched.
WANTED_BITS = 23
#: Rows of one name that may meet in a task, and names that are broadcast at most.
HOT_ROWS, MOST_HOT = 1_000_000, 100_000
LEAF = 8
#: Bytes of a whole token that are shuffled; a part has some ENTRIES_PER_PART of them.
TOKEN_BYTES = 5
#: Places of a prefix that entries tell apart, two to a byte; holders of a token beyond so many all stay.
PLACES, FEW_HOLDERS = 16, 64
#: Bits of a bitmap for each token, at least. With one, the pipeline's join read 1.6 million rows on check_l, not 1.2.
BITS_A_TOKEN = 2


def _linked(overlap, n_x, n_y):
    """OF * overlap >= SHARE * union, in integers."""
    return (OF + SHARE) * overlap >= SHARE * (n_x + n_y)


def set_name(tokens: np.ndarray) -> int:
    """A 64-bit name of a token set, as a signed integer."""
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64)], np.uint64) + np.uint64(len(tokens))).view(np.int64)[0])


def give_back() -> None:
    """Hands this Python worker's unused memory to the system; Spark keeps workers, with all they have ever held, from stage to stage."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _sets(batch):
    """For each chunk of an Arrow batch with a text column: its first row number and its token sets."""
    raw, at = flat(batch.column("text"))
    for lo, hi in chunks(at):
        yield lo, shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])


def size_class(n: int) -> int:
    """The least k with n <= 2**k; sets that may be linked differ by one at most."""
    return max(0, int(n - 1).bit_length())


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A set's bitmap: BITS_A_TOKEN * 2**size_class bits (64 at least), each token setting one."""
    bits = max(64, BITS_A_TOKEN << size_class(len(tokens)))
    on = np.zeros(bits, bool)
    on[(mix(tokens) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").view(np.uint64)


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _texts(docs: DataFrame):
    """(th, text): whole texts and their 64-bit names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text).alias("th"), text.alias("text")


def _describe(docs: DataFrame) -> DataFrame:
    """One pass: rows of kind 0 with doc_id, th, n, name and bitmap; rows of kind 1 with a slice of the task's token counters."""
    def run(batches):
        import pyarrow as pa

        give_back()
        seen = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["kind", "doc_id", "th", "n", "name", "blob"]
        for batch in batches:
            n, name, maps = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for lo, sets in _sets(batch):
                for i, s in enumerate(sets, lo):
                    if len(s):
                        n[i], name[i], maps[i] = len(s), set_name(s), bitmap(s).tobytes()
                seen += np.bincount(_slot(np.concatenate(sets)), minlength=len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column("doc_id"), batch.column("th"), pa.array(n), pa.array(name), pa.array(maps, pa.binary())], names=names)
        told = [(k, zlib.compress(seen[k << SLICE_BITS : (k + 1) << SLICE_BITS].tobytes(), 1)) for k in range(len(seen) >> SLICE_BITS) if seen[k << SLICE_BITS : (k + 1) << SLICE_BITS].any()]
        if told:
            none = pa.array(np.zeros(len(told), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(told), np.int32)), pa.array([k for k, _ in told], pa.int64()), none, none, none, pa.array([c for _, c in told], pa.binary())], names=names)
        del seen, told
        give_back()

    th, text = _texts(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), th, text).mapInArrow(run, "kind int, doc_id long, th long, n long, name long, blob binary")


def _counts(described: DataFrame) -> np.ndarray:
    """Token counters of all documents. Slices are summed FAN_IN at a time, so no task gathers what all tasks have counted."""
    def add(table):
        import pyarrow as pa

        total = np.zeros(1 << SLICE_BITS, np.int64)
        for c in table.column("blob"):
            total += np.frombuffer(zlib.decompress(c.as_py()), np.int64)
        return pa.table({"k": table.column("k")[:1], "blob": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = described.where("kind = 1").select(F.col("doc_id").alias("k"), "blob")
    most = parts.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    while True:
        groups = -(-most // FAN_IN)
        parts = parts.withColumn("g", F.pmod(F.xxhash64("blob"), F.lit(max(1, groups)))).groupBy("k", "g").applyInArrow(add, "k long, blob binary")
        if groups <= 1:
            break
        parts, most = cut(parts), groups
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in parts.collect():  # 64 rows of 128 kB
        counts[r["k"] << SLICE_BITS : (r["k"] + 1) << SLICE_BITS] = np.frombuffer(zlib.decompress(bytes(r["blob"])), np.int64)
    return counts


def _order(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each counter: 0 if its tokens are about as rare as chance has it, else a class that grows with the count; and to how many blocks a token's holders are dealt."""
    usual = 2 * counts.mean() + 16
    classes = np.where(counts > usual, np.minimum(15, 1 + np.log2(np.maximum(counts, 1) / usual)), 0).astype(np.uint8)
    return classes, np.minimum(65_535, -(-counts // HOT_ENTRIES)).astype(np.uint16)


def packed(token: np.ndarray, name: np.ndarray, n: np.ndarray, block: np.ndarray) -> bytes:
    """A part's entries, column by column so that they compress: a whole token by TOKEN_BYTES of its bytes only.

    Two whole tokens of a part that these don't tell apart share their holders, which adds candidates and loses none;
    a divided token names its group in all parts and keeps all bytes.
    """
    raw = token.astype("<u8").view(np.uint8).reshape(-1, 8)
    rest = np.where(block[:, None] > 0, raw[:, TOKEN_BYTES:], np.uint8(0))
    return raw[:, :TOKEN_BYTES].tobytes() + rest.tobytes() + name.astype("<i8").tobytes() + n.astype("<u4").tobytes() + block.astype("<u4").tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, name, n, block) of packed entries; tokens as signed integers."""
    k = len(raw) // 24
    low = np.frombuffer(raw, np.uint8, k * TOKEN_BYTES).reshape(k, TOKEN_BYTES)
    rest = np.frombuffer(raw, np.uint8, k * (8 - TOKEN_BYTES), k * TOKEN_BYTES).reshape(k, 8 - TOKEN_BYTES)
    token = np.ascontiguousarray(np.concatenate([low, rest], 1)).view("<i8")[:, 0]
    return token, np.frombuffer(raw, "<i8", k, 8 * k), np.frombuffer(raw, "<u4", k, 16 * k), np.frombuffer(raw, "<u4", k, 20 * k)


def prefix_length(n):
    """Two linked sets share one of so many first tokens of each."""
    return n + (-SHARE * n) // OF + 1


def place(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """In which of PLACES equal parts of a prefix its ``at``-th token (from 0) is."""
    return (PLACES * at // prefix_length(n)).astype(np.uint8)


def reach(place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The largest set that one of ``n`` tokens may be linked with, if the first token that both have is in that place of its prefix."""
    at = -(-place.astype(np.int64) * prefix_length(n) // PLACES)
    return (OF + SHARE) * (n - at) // SHARE - n


def _halves(x: np.ndarray) -> bytes:
    """Numbers below 16, two to a byte."""
    x = np.append(x, np.zeros(len(x) % 2, np.uint8))
    return (x[::2] | x[1::2] << 4).astype(np.uint8).tobytes()


def _whole(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8)
    return np.stack([x & 15, x >> 4], 1).ravel()[:n]


def _prefixes(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """(part, entries, places): each task's prefix tokens for a part as bytes, (token, set name, set size, block of the token) each, and their places; equal sets of a task count once."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # bounded: 3 MB

    def run(batches):
        import pyarrow as pa

        give_back()
        classes, splits = shared.value
        done: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush():
            token = np.concatenate([h[0] for h in held])
            many = [len(h[0]) for h in held]
            name = np.repeat(np.array([h[1] for h in held], np.int64), many)
            n = np.repeat(np.array([h[2] for h in held], np.uint32), many)
            where = place(np.concatenate([np.arange(k) for k in many]), n.astype(np.int64))
            split = splits[_slot(token)].astype(np.uint64)
            # 0: the token is whole; else 1 + the block that the name falls in
            block = np.where(split > 1, 1 + mix(name.view(np.uint64) + np.uint64(1)) % np.maximum(split, np.uint64(1)), 0).astype(np.uint32)
            part = (mix(token + block) % np.uint64(parts)).astype(np.int64)
            by = np.lexsort((n, part))
            edge = np.concatenate(([0], np.flatnonzero(np.diff(part[by])) + 1, [len(by)])).tolist()
            token, name, n, block, where = token[by], name[by], n[by], block[by], where[by]
            spans = list(zip(edge[:-1], edge[1:], strict=True))
            entries = pa.array([packed(token[a:b], name[a:b], n[a:b], block[a:b]) for a, b in spans], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(part[by][edge[:-1]].astype(np.int32)), entries, pa.array([_halves(where[a:b]) for a, b in spans], pa.binary())], names=["part", "entries", "places"])

        for batch in batches:
            for _, sets in _sets(batch):
                for s in sets:
                    if not len(s) or (name := set_name(s)) in done:
                        continue
                    done.add(name)
                    k = prefix_length(len(s))
                    c = classes[_slot(s)]
                    if c.any():
                        s = s[np.argsort(c, kind="stable")]
                    held.append((s[:k], name, len(s)))
                    size += k
                    if size > 2_000_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()
        done, held = set(), []
        give_back()

    return docs.select(_texts(docs)[1]).mapInArrow(run, "part int, entries binary, places binary")


def _edge(token: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Where the runs of equal tokens and blocks begin, and the end."""
    return np.concatenate(([0], np.flatnonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1])) + 1, [len(token)])) if len(token) else np.zeros(1, np.int64)


def partnered(edge: np.ndarray, n: np.ndarray, most: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Which holders another holder of their token may be linked with by this token: neither is larger than the other's ``most``. Of divided tokens and of those with over FEW_HOLDERS all are."""
    size = np.repeat(np.diff(edge), np.diff(edge))
    keep = (block > 0) | (size > FEW_HOLDERS)
    behind = np.where(keep, 0, np.repeat(edge[1:], np.diff(edge)) - 1 - np.arange(len(n)))
    x, d = np.flatnonzero(behind > 0), 1
    while len(x):
        y = x + d
        ok = (n[y] <= most[x]) & (n[x] <= most[y])
        keep[x[ok]] = keep[y[ok]] = True
        d += 1
        x = x[behind[x] >= d]
    return keep


def holders(token: np.ndarray, name: np.ndarray, n: np.ndarray, block: np.ndarray, most: int, largest: np.ndarray) -> list[tuple[int, int, bool, np.ndarray, np.ndarray]]:
    """The groups of a part's entries: (gid, block, whether the group has other blocks, names, sizes).

    ``largest`` is an entry's reach. Tokens with the same holders give one group; a whole token of one holder gives none.
    """
    by = np.lexsort((-largest, name, n, block, token))
    token, name, n, block, largest = token[by], name[by], n[by], block[by], largest[by]
    if len(token):
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (block[1:] != block[:-1]) | (name[1:] != name[:-1])
        token, name, n, block, largest = token[fresh], name[fresh], n[fresh], block[fresh], largest[fresh]
        keep = partnered(_edge(token, block), n, largest, block)
        token, name, n, block = token[keep], name[keep], n[keep], block[keep]
    edge = _edge(token, block)
    at, end = edge[:-1], edge[1:]
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(name.view(np.uint64)), dtype=np.uint64)))
    gid = np.where(block[at] > 0, mix(token[at].view(np.uint64)), mix(total[end] - total[at] + (end - at).astype(np.uint64))).view(np.int64)
    _, first = np.unique(np.stack([gid, block[at].astype(np.int64)], 1), axis=0, return_index=True)
    out = []
    for k in first.tolist():
        lo, hi, split = int(at[k]), int(end[k]), int(block[at[k]])
        if hi - lo < 2 and not split:
            continue
        slices = range(lo, hi, most)
        out += [(int(gid[k]), split << 16 | i, split > 0 or len(slices) > 1, name[x : min(hi, x + most)], n[x : min(hi, x + most)]) for i, x in enumerate(slices)]
    return out


def _groups(prefixes: DataFrame, most: int) -> DataFrame:
    """gid, block, divided, names, sizes: blocks of at most ``most`` sets that share a prefix token."""
    def run(table):
        import pyarrow as pa

        parts = [unpacked(blob.as_py()) for blob in table.column("entries")]
        where = np.concatenate([_whole(blob.as_py(), len(p[0])) for blob, p in zip(table.column("places"), parts, strict=True)])
        token, name, n, block = (np.concatenate(x) for x in zip(*parts, strict=True))
        # tokens of one entry go first, cheaply
        _, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
        keep = (count[inverse] > 1) | (block > 0)
        token, name, n, block, where = token[keep], name[keep], n[keep].astype(np.int64), block[keep], where[keep]
        got = holders(token, name, n, block, most, reach(where, n))
        offsets = np.concatenate(([0], np.cumsum([len(g[3]) for g in got]))).astype(np.int32)
        del parts, token, name, n, block, where, inverse, count, keep
        lists = [pa.ListArray.from_arrays(offsets, np.concatenate([g[c] for g in got]) if got else np.zeros(0, np.int64)) for c in (3, 4)]
        return pa.table([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.bool_()), *lists], names=["gid", "block", "divided", "names", "sizes"])

    return prefixes.groupBy("part").applyInArrow(run, "gid long, block long, divided boolean, names array<long>, sizes array<long>").dropDuplicates(["gid", "block"])


def with_least(rows: DataFrame, key: str, value, name: str, n: int, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` (``n`` of them) with the least ``value`` of their key's rows as ``name``.

    The least comes from a combined aggregate. Rows of a key with more than ``hot`` rows (more, where there are so many
    rows that over MOST_HOT keys could have that) aren't gathered in a task: at most MOST_HOT keys are broadcast to them.
    """
    low = rows.groupBy(key).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("rows__"))
    limit = max(hot, n // MOST_HOT)
    if n <= limit:
        return rows.join(low.drop("rows__"), key)
    busy = F.broadcast(low.where(F.col("rows__") > limit).drop("rows__"))
    quiet = rows.join(busy.select(key), key, "left_anti").join(low.where(F.col("rows__") <= limit).drop("rows__"), key)
    return quiet.unionByName(rows.join(busy, key))


def components(links: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """(name, root): the smallest name reachable over (a, b) links, for every name with a link.

    Alternating large and small stars: each round reattaches neighbours to the smallest known
    neighbour; rounds grow with the logarithm of a component's size. The links of a name with very
    many are spread over tasks, see ``with_least``.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", F.col("v"), "m", 2 * n, hot).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_least(large, "u", F.col("v"), "m", n, hot)
        edges = cut(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            break
        last, n = now, now[0]
    root = edges.select(F.col("u").alias("name"), F.col("v").alias("root"))
    return cut(root.unionByName(root.select(F.col("root").alias("name"), "root")).distinct())


def fold(raw: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at a shorter length of ``words`` 64-bit words; it stays an upper bound."""
    return np.bitwise_or.reduce(raw.reshape(-1, words), 0)


class SignatureTree:
    """Bitmaps of one length in the order given; a level's node has LEAF nodes of the level below.

    A node holds the OR of its bitmaps, its least and largest size, how many tokens its sets
    have beyond one a bit at most, and the least and largest of its members' labels.
    """

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        extra = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, extra, labels, labels)]
        while len(self.levels[-1][0]) > 1:
            low = self.levels[-1]
            at = np.arange(0, len(low[0]), LEAF)
            self.levels.append(tuple(f.reduceat(x, at) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), low, strict=True)))

    def may(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of nodes a and b may be linked."""
        maps, least, most, extra = self.levels[level][:4]
        ok = np.flatnonzero((OF * most[a] >= SHARE * least[b]) & (OF * most[b] >= SHARE * least[a]))
        x, y = a[ok], b[ok]
        common = np.bitwise_count(maps[x] & maps[y]).sum(1, dtype=np.int64) + np.minimum(extra[x], extra[y])
        out = np.zeros(len(a), bool)
        out[ok] = _linked(np.minimum(common, np.minimum(most[x], most[y])), least[x], least[y])
        return out

    def pairs(self, labels: np.ndarray):
        """Index pairs of sets that may be linked and have different labels, in blocks; labels may change meanwhile."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        step = np.arange(LEAF)
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                new = labels[a] != labels[b]
            else:
                lo, hi = self.levels[level][4:]
                new = (lo[a] != hi[a]) | (lo[b] != hi[b]) | (lo[a] != lo[b])
            a, b = a[new], b[new]
            ok = self.may(level, a, b)
            a, b = a[ok], b[ok]
            if level == 0:
                yield a, b
                continue
            n = len(self.levels[level - 1][0])
            for at in range(0, len(a), 64):
                p = np.repeat(a[at : at + 64, None] * LEAF + step, LEAF, 1).ravel()
                q = np.tile(b[at : at + 64, None] * LEAF + step, LEAF).ravel()
                ok = (p < n) & (q < n) & ((p < q) if level == 1 else (p <= q))
                todo.append((level - 1, p[ok], q[ok]))


def search(sizes: np.ndarray, maps: list[np.ndarray], labels: np.ndarray, check=None) -> list[tuple[int, int]]:
    """Links between sets of different labels, as a forest: pairs of indices that join them as far as any links do.

    Pairs that the tree lets through count as links, or are put to ``check``. Neighbours in
    size and the most central set are visited first, so that most pairs of a group of near
    copies need no visit. ``labels`` are merged in place.
    """
    links: list[tuple[int, int]] = []
    held: dict[int, list[int]] = {}
    for i, label in enumerate(labels.tolist()):
        held.setdefault(label, []).append(i)

    def visit(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = int(labels[i]), int(labels[j])
            if x != y and (check is None or check(i, j)):
                links.append((i, j))
                if len(held[x]) < len(held[y]):
                    x, y = y, x
                fewer = held.pop(y)  # the smaller side is renamed, so a set is renamed some log2(n) times
                labels[fewer] = x
                held[x] += fewer

    kinds = np.array([size_class(int(n)) for n in sizes])
    for k in np.unique(kinds):
        # sets of one size class with each other and with the next larger class
        pick = np.flatnonzero((kinds == k) | (kinds == k + 1))
        if len(pick) < 2 or (labels[pick] == labels[pick[0]]).all():
            continue
        words = max(1, (BITS_A_TOKEN << int(k)) // 64)
        pick = pick[np.argsort(sizes[pick], kind="stable")]
        folded = np.stack([fold(maps[i], words) for i in pick])
        if len(pick) > 2:
            tree = SignatureTree(folded, sizes[pick], labels[pick])
            x = np.arange(len(pick) - 1)
            near = tree.may(0, x, x + 1)
            visit(pick[x[near]], pick[x[near] + 1])
            often = 2 * np.unpackbits(folded.view(np.uint8), axis=1).sum(0, dtype=np.int64) >= len(pick)
            center = int(np.bitwise_count(folded & np.packbits(often).view(np.uint64)).sum(1).argmax())
            x = np.delete(np.arange(len(pick)), center)
            near = tree.may(0, np.full(len(x), center), x)
            visit(np.full(int(near.sum()), pick[center]), pick[x[near]])
            by = np.lexsort((sizes[pick], labels[pick]))
            pick, folded = pick[by], folded[by]
        tree = SignatureTree(folded, sizes[pick], labels[pick])
        own = labels[pick]
        for a, b in tree.pairs(own):
            visit(pick[a], pick[b])
            own[:] = labels[pick]
    return links


def _edges(schema_rows: list[tuple[int, int]]):
    import pyarrow as pa

    return pa.table({"a": pa.array([x for x, _ in schema_rows], pa.int64()), "b": pa.array([y for _, y in schema_rows], pa.int64())})


def _spans(*keys: np.ndarray):
    """(lo, hi) of each run of equal keys."""
    edge = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
    return zip([0, *edge.tolist()], [*edge.tolist(), len(keys[0])], strict=True)


def _candidates(members: DataFrame, maps: DataFrame, rows: int) -> DataFrame:
    """(a, b) candidate links of each block of ``members`` (gid, block, name, n, root), by a signature tree a block."""
    def run(table):
        order = table.sort_by([("gid", "ascending"), ("block", "ascending")])
        gid, block, name, n, root = (order.column(c).to_numpy() for c in ("gid", "block", "name", "n", "root"))
        maps_ = [np.frombuffer(x.as_py(), np.uint64) for x in order.column("map")]
        found = set()
        for lo, hi in _spans(gid, block):
            labels = np.unique(root[lo:hi], return_inverse=True)[1]
            for i, j in search(n[lo:hi], maps_[lo:hi], labels):
                a, b = int(name[lo + i]), int(name[lo + j])
                found.add((min(a, b), max(a, b)))
        del order, maps_
        give_back()
        return _edges(sorted(found))

    # a task call takes several whole blocks
    bundles = max(1, -(-rows // BUNDLE_ROWS))
    bundled = members.join(maps, "name").withColumn("bundle", F.pmod(F.xxhash64("gid", "block"), F.lit(bundles)).cast("int"))
    return bundled.groupBy("bundle").applyInArrow(run, "a long, b long").distinct()


def _rooted(members: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``members`` with their roots, of those keys that have several."""
    told = members.drop("root").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    several = told.groupBy(key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select(key, "m")
    return cut(told.join(several, key))


def _across(told: DataFrame, maps: DataFrame, most: int) -> DataFrame:
    """(a, b) candidate links between blocks: a table of nodes (bounded groups of a group's sets of like size), joined by group and size where node bitmaps, sizes and roots allow a link."""
    ranged = told.withColumn("r", F.floor(F.log("n") / float(np.log(OF / SHARE))).cast("int"))
    parts = ranged.groupBy("gid", "r").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    placed = ranged.join(parts, ["gid", "r"]).withColumn("c", F.pmod(F.xxhash64("name", F.lit(9)), F.col("parts")).cast("int"))

    def node(table):
        import pyarrow as pa

        n, root = table.column("n").to_numpy(), table.column("root").to_numpy()
        maps_ = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("map")]
        words = min(len(m) for m in maps_)
        folded = [fold(m, words) for m in maps_]
        extra = max(int(k) - int(np.bitwise_count(f).sum()) for k, f in zip(n, folded, strict=True))
        one = {"gid": table.column("gid")[:1], "r": table.column("r")[:1], "c": table.column("c")[:1]}
        one |= {"words": [words], "signature": [np.bitwise_or.reduce(np.stack(folded), 0).tobytes()], "extra": [extra], "least": [int(n.min())], "most": [int(n.max())], "lo": [int(root.min())], "hi": [int(root.max())]}
        return pa.table(one | {c: pa.array([table.column(c).to_pylist()], pa.list_(kind)) for c, kind in (("name", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("map", pa.binary()))})

    head = "gid long, r int, c int, words long, signature binary, extra long, least long, most long, lo long, hi long"
    nodes = cut(placed.select("gid", "r", "c", "name", "n", "root").join(maps, "name").groupBy("gid", "r", "c").applyInArrow(node, f"{head}, name array<long>, n array<long>, root array<long>, map array<binary>"))
    columns = [f.split()[0] for f in head.split(", ")]
    x = nodes.select(*columns)
    y = nodes.select("gid", *[F.col(c).alias(f"{c}_y") for c in columns[1:]])
    y = y.withColumn("r", F.explode(F.array(F.col("r_y"), F.col("r_y") - 1)))
    pairs = x.join(y, ["gid", "r"]).where("(r < r_y or c <= c_y) and not (lo = hi and lo_y = hi_y and lo = lo_y)").where(f"{OF} * most_y >= {SHARE} * least and {OF} * most >= {SHARE} * least_y")

    def allowed(parts):
        for pdf in parts:
            ok = []
            for p in pdf.itertuples():
                words = min(p.words, p.words_y)
                common = np.bitwise_count(fold(np.frombuffer(p.signature, np.uint64), words) & fold(np.frombuffer(p.signature_y, np.uint64), words)).sum()
                # folding may add tokens beyond one a bit: all of a node's largest set, at worst
                more = min(p.extra, p.extra_y) if p.words == p.words_y else min(p.most, p.most_y)
                ok.append(_linked(min(int(common) + more, p.most, p.most_y), p.least, p.least_y))
            yield pdf.loc[np.array(ok, bool), ["gid", "r", "c", "r_y", "c_y"]]

    pairs = cut(pairs.select(*x.columns, *[c for c in y.columns if c.endswith("_y")]).mapInPandas(allowed, "gid long, r int, c int, r_y int, c_y int"))
    body = ["name", "n", "root", "map"]
    full = pairs.join(nodes.select("gid", "r", "c", *body), ["gid", "r", "c"])
    full = full.join(nodes.select("gid", F.col("r").alias("r_y"), F.col("c").alias("c_y"), *[F.col(c).alias(f"{c}_y") for c in body]), ["gid", "r_y", "c_y"])

    def meet(batches):
        for batch in batches:
            for row in batch.to_pylist():
                both = {n: (m, r, raw) for s in ("", "_y") for n, m, r, raw in zip(row[f"name{s}"], row[f"n{s}"], row[f"root{s}"], row[f"map{s}"], strict=True)}
                name = list(both)
                labels = np.unique([both[k][1] for k in name], return_inverse=True)[1]
                got = search(np.array([both[k][0] for k in name]), [np.frombuffer(both[k][2], np.uint64) for k in name], labels)
                yield from _edges([(name[i], name[j]) for i, j in got]).to_batches()

    return full.select(*body, *[f"{c}_y" for c in body]).mapInArrow(meet, "a long, b long").distinct()


def _clusters(groups: DataFrame, maps: DataFrame, most: int) -> DataFrame:
    """(name, root) of every set with a candidate link: no link leads out of a cluster."""
    size, divided = groups.agg(F.sum(F.size("names")), F.max("divided")).first()
    members = groups.select("gid", "block", "divided", F.explode(F.arrays_zip("names", "sizes")).alias("x")).select("gid", "block", "divided", F.col("x.names").alias("name"), F.col("x.sizes").alias("n"))
    edges = cut(_candidates(members.withColumn("root", F.col("name")), maps, size or 0))
    roots = components(edges)
    if not divided:
        return roots
    split = members.where("divided").select("gid", "name", "n")
    # the blocks of a divided group: dealt anew, then node by node
    told = _rooted(split, roots, "gid").withColumn("block", F.pmod(F.xxhash64("name", F.lit(1)), F.ceil(F.col("m") / most)))
    edges = edges.unionByName(cut(_candidates(told, maps, told.count())))
    told = _rooted(split, components(edges), "gid")
    return components(edges.unionByName(cut(_across(told, maps, most))))


def _wanted(docs: DataFrame, ths: DataFrame) -> DataFrame:
    """(th, text): each wanted text once, compressed as it is shuffled twice. A table of 2**WANTED_BITS bits keeps most others out before any text is shuffled; beyond that many the join does."""
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << WANTED_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low("th").bitwiseAND(F.lit(63)).cast("int"))
    bits = cut(ths.groupBy(F.shiftright(low("th"), 6).alias("w")).agg(F.bit_or(bit).alias("b")))  # at most 2**17 rows
    some = docs.select(*_texts(docs)).withColumns({"w": F.shiftright(low("th"), 6), "bit": bit}).join(F.broadcast(bits), "w").where("b & bit <> 0")

    def shorten(batches):
        import pyarrow as pa

        for batch in batches:
            raw, at = flat(batch.column("text"))
            told = memoryview(raw)
            yield pa.RecordBatch.from_arrays([batch.column("th"), pa.array([zlib.compress(told[a:b], 1) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["th", "text"])

    return some.select("th", "text").mapInArrow(shorten, "th long, text binary").groupBy("th").agg(F.first("text").alias("text"))


def _unzipped(blobs: list[bytes]) -> list[np.ndarray]:
    """The token sets of compressed texts."""
    texts = [zlib.decompress(b) for b in blobs]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return [s for lo, hi in chunks(at) for s in shingle_sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])]


def _exact(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) links inside each task key of ``placed`` (key, bundle, name, th, label), checked on whole sets."""
    def run(table):
        order = table.sort_by([("key", "ascending"), ("name", "ascending")])
        key, name, label = (order.column(c).to_numpy() for c in ("key", "name", "label"))
        sets = _unzipped([blob.as_py() for blob in order.column("text")])
        found = []
        for lo, hi in _spans(key):
            own, n = sets[lo:hi], np.array([len(s) for s in sets[lo:hi]])
            labels = np.unique(label[lo:hi], return_inverse=True)[1]

            def check(i, j, own=own):
                x, y = (own[i], own[j]) if len(own[i]) < len(own[j]) else (own[j], own[i])
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                return bool(_linked(int((y[at] == x).sum()), len(x), len(y)))

            found += [(int(name[lo + i]), int(name[lo + j])) for i, j in search(n, [bitmap(s) for s in own], labels, check)]
        del order, sets, own, check
        give_back()
        return _edges(found)

    return placed.join(texts, "th").select("key", "bundle", "name", "label", "text").groupBy("bundle").applyInArrow(run, "a long, b long").distinct()


def _dealt(members: DataFrame, tokens: int, seed: int) -> DataFrame:
    """``members`` (root, name, n, blocks, ..) with the task key of their cluster's block and a bundle of keys for a task call."""
    block = F.pmod(F.xxhash64("name", F.lit(seed)), F.col("blocks"))
    keyed = members.withColumn("block", block).withColumn("key", F.xxhash64("root", "block"))
    return keyed.withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-tokens // BUNDLE_TOKENS)))).cast("int"))


def _links(docs: DataFrame, sets: DataFrame, clusters: DataFrame, block_tokens: int) -> DataFrame:
    """(a, b) links, a forest of each component."""
    members = clusters.join(sets, "name")
    weights = members.groupBy("root").agg(F.ceil(F.sum("n") / block_tokens).alias("blocks"))
    members = cut(members.join(weights, "root"))
    tokens, most = members.agg(F.sum("n"), F.max("blocks")).first()
    texts = _wanted(docs, members.select("th"))
    links = cut(_exact(_dealt(members, tokens or 0, 0).withColumn("label", F.col("name")), texts))
    if (most or 0) <= 1:
        return links
    # clusters too large for a task: dealt anew, then block by block
    large = members.where("blocks > 1").withColumnRenamed("root", "cluster")
    named = lambda told: told.withColumnRenamed("root", "label").withColumnRenamed("cluster", "root")
    told = named(_rooted(large, components(links), "cluster"))
    links = links.unionByName(cut(_exact(_dealt(told, told.agg(F.sum("n")).first()[0] or 0, 1), texts)))
    told = named(_rooted(large, components(links), "cluster"))
    last = cut(_dealt(told, 1, 1).drop("key", "bundle"))
    heads = last.groupBy("root", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    other = heads.select("root", *[F.col(c).alias(f"{c}_y") for c in heads.columns[1:]])
    pairs = heads.join(other, "root").where("block < block_y and not (lo = hi and lo_y = hi_y and lo = lo_y)").where(f"{OF} * most_y >= {SHARE} * least and {OF} * most >= {SHARE} * least_y")
    sides = pairs.withColumn("key", F.xxhash64("root", "block", "block_y")).select("root", "key", F.explode(F.array("block", "block_y")).alias("block"))
    met = last.join(sides, ["root", "block"])
    # a key has at most two blocks, and a task call takes one key
    met = met.withColumn("bundle", F.col("key"))
    return links.unionByName(cut(_exact(met, texts)))


def similarity_links(docs: DataFrame, group_rows: int = GROUP_ROWS, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(described documents with doc_id, th, n, name; (a, b): checked links between different sets' names, a spanning forest of each component)."""
    described = cut(_describe(docs))
    rows = described.where("kind = 0").select("doc_id", "th", "n", "name")
    entries = rows.agg(F.sum(F.col("n") - F.ceil(F.col("n") * SHARE / OF) + 1)).first()[0] or 0
    parts = max(1, -(-int(entries) // ENTRIES_PER_PART))
    groups = cut(_groups(_prefixes(docs, _order(_counts(described)), parts), group_rows))
    release(docs.sparkSession)
    sets = described.where("kind = 0 and n > 0").groupBy("name").agg(F.min("n").alias("n"), F.min("th").alias("th"))
    used = groups.select(F.explode("names").alias("name")).distinct()
    maps = described.where("kind = 0 and n > 0").select("name", F.col("blob").alias("map")).join(used, "name", "left_semi").dropDuplicates(["name"])
    clusters = _clusters(groups, maps, group_rows)
    del groups, used, maps
    release(docs.sparkSession)
    return rows, _links(docs, sets, clusters, block_tokens)


def _rooted_rows(docs: DataFrame, group_rows: int, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(described documents, (name, root) of the sets that have a link)."""
    rows, links = similarity_links(docs, group_rows, block_tokens)
    roots = components(links)
    del links
    release(docs.sparkSession)
    return rows, roots


def _classes(rows: DataFrame, roots: DataFrame, least) -> DataFrame:
    """(name, root, least) of each distinct set: its component and its rows' smallest ``least``."""
    classes = rows.where("n > 0").groupBy("name").agg(F.min(least).alias("least"))
    return classes.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))


def representatives(docs: DataFrame, group_rows: int = GROUP_ROWS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a component: the smallest doc_id (nulls last) and, of its texts, the smallest 64-bit hash.

    The same defined cases as join(); documents without words have no row.

    Returns absent (whether the id is null), id (0 if null), th (xxhash64 of the text).
    """
    rows, roots = _rooted_rows(docs, group_rows, block_tokens)
    key = F.struct(F.col("doc_id").isNull().alias("absent"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th")
    return _classes(rows, roots, key).groupBy("root").agg(F.min("least").alias("head")).select("head.*")


def spanning_links(docs: DataFrame, group_rows: int = GROUP_ROWS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Checked links between representatives of equal sets, a spanning forest of every component: with join() as the membership, what tells why documents are together.

    Returns a, b (the smallest doc_ids of the two sets; null if a set's rows have none), n_a, n_b (shingles).
    The same defined cases as join(); documents with equal sets are one representative.
    """
    rows, links = similarity_links(docs, group_rows, block_tokens)
    one = rows.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"))
    side = lambda c: one.select(F.col("name").alias(c), F.col("id").alias(f"id_{c}"), F.col("n").alias(f"n_{c}"))
    return links.join(side("a"), "a").join(side("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b")


def join(docs: DataFrame, group_rows: int = GROUP_ROWS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Shingle count and component of every document.

    ``group_rows`` and ``block_tokens`` bound what one task searches at once; the result is the
    same for any.

    Defined cases: a null, empty or blank text has no shingles and links with nothing; fewer
    than five words are one shingle; equal sets are linked; repeated rows and repeated doc_ids
    each get a row; a document whose doc_id is null gets its component's smallest id, or null;
    an empty table gives an empty result; other columns are ignored.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable).
    """
    rows, roots = _rooted_rows(docs, group_rows, block_tokens)
    placed = with_least(_classes(rows, roots, F.col("doc_id")), "root", F.col("least"), "component_id", rows.count())
    named = placed.select(F.col("name").alias("c"), "component_id")
    out = rows.join(named, (F.col("name") == F.col("c")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
