"""A Merkle manifest of a dataset, with a witness for every row.

Rows become leaves; the leaves of a language, in order, are paired up to a subroot, and the
subroots to one root. Witnesses are made by appending: a forest of open subtrees holds each
leaf's partial witness; when a subtree gets its right sibling, the sibling's digest is added to the
witnesses of both. Blocks of 2**b neighbouring leaves begin at multiples of 2**b, so each is a
subtree of its own and is appended by one task; the blocks' roots are the leaves of the next round,
appended in the same way, until each language has one node.

Spark plan: texts are hashed where they are read; only narrow rows (two digests, id, language) are
sorted by range and numbered from counts a partition. Then rows meet by (language, block), at most
2**b together: once for the blocks' roots, once for the witnesses, which are finished by what stands
above their block. A language may hold all rows: it's as many blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Leaves of a block: 2**BITS.
BITS = 10
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values: dict[str, Column]) -> Column:
    """Digest of a row's fields: each is its UTF-8 length, a colon and the value, or ``-`` if null."""
    told = [v.cast("string") for v in values.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told]), 256)


class Forest:
    """The open subtrees of an append, from the largest to the smallest, as (height, digest, its leaves' witnesses).

    A witness is a list of steps from the leaf up: `L` or `R` (the side on which the sibling
    stands) and the sibling's digest, or `S` for a node without a sibling, which is hashed alone.
    """

    def __init__(self, witnesses: bool = True):
        self.open: list[tuple[int, str, list[list[str]]]] = []
        self.witnesses = witnesses

    def append(self, hashed: str) -> None:
        tree = (0, hashed, [[]] if self.witnesses else [])
        while self.open and self.open[-1][0] == tree[0]:
            tree = self._complete(self.open.pop(), tree)
        self.open.append(tree)

    @staticmethod
    def _complete(left, right):
        for w in left[2]:
            w.append("R" + right[1])
        for w in right[2]:
            w.append("L" + left[1])
        left[2].extend(right[2])
        return left[0] + 1, digest(left[1] + right[1]), left[2]

    def close(self, height: int) -> tuple[str, list[list[str]]]:
        """(root, witnesses in order) once nothing more comes: lone last nodes are hashed up to the next larger subtree, at last to ``height``."""
        tree = self.open.pop()
        while True:
            for _ in range((self.open[-1][0] if self.open else height) - tree[0]):
                for w in tree[2]:
                    w.append("S")
                tree = (tree[0] + 1, digest(tree[1]), tree[2])
            if not self.open:
                return tree[1], tree[2]
            tree = self._complete(self.open.pop(), tree)


def fold(hashed: str, witness: str) -> str:
    """The root that a leaf and a witness (steps joined by blanks) lead to."""
    for step in witness.split():
        hashed = digest(hashed + step[1:] if step[0] == "R" else step[1:] + hashed if step[0] == "L" else hashed)
    return hashed


def numbered(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``df`` with ``pos``, a row's place within its ``group`` from 0, and ``n``, the group's rows.

    Rows are dealt by range of (group, order, input place), so a group may hold all of them and
    rows may be alike; places follow from counts a partition.
    """
    spark = df.sparkSession
    by = [F.col(group).asc_nulls_first(), *order, F.col("tie__")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    dealt = df.withColumn("tie__", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = cut(dealt.drop("tie__").withColumn("at__", F.monotonically_increasing_id()))
    part = F.shiftright("at__", 33)
    runs = placed.groupBy(F.col(group).alias("g__"), part.alias("p__")).agg(F.min("at__").alias("first__"), F.count(F.lit(1)).alias("n__"))
    whole = Window.partitionBy("g__")
    shift = F.sum("n__").over(whole.orderBy("p__").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n__") - F.col("first__")
    runs = runs.select("g__", "p__", shift.alias("shift__"), F.sum("n__").over(whole).alias("n"))  # a row for each partition and group in it
    met = placed.join(runs, F.col(group).eqNullSafe(F.col("g__")) & (part == F.col("p__")))
    return met.select(*df.columns, (F.col("at__") + F.col("shift__")).alias("pos"), "n")


def _blocks(rows: Iterator[tuple], bits: int, witnesses: bool) -> Iterator[tuple[list[tuple], str, list[list[str]]]]:
    """(rows, root, witnesses) of each block of rows (group, pos, n, hash, ...) that come block by block, in order."""
    def closed():
        n = held[0][2]
        return (held, *forest.close(bits if n > 1 << bits else (n - 1).bit_length()))

    held: list[tuple] = []
    for row in rows:
        if held and (row[0] != held[0][0] or row[1] >> bits != held[0][1] >> bits):
            yield closed()
            held = []
        if not held:
            forest = Forest(witnesses)
        held.append(row)
        forest.append(row[3])
    if held:
        yield closed()


def _together(nodes: DataFrame, bits: int) -> DataFrame:
    by = ["group", "block"]
    return nodes.withColumn("block", F.shiftright("pos", bits)).repartition(*by).sortWithinPartitions(*by, "pos")


def _listed(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batch(rows: list[tuple], kinds):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def block_roots(nodes: DataFrame, bits: int) -> DataFrame:
    """(group, pos, n, hash) of the blocks of such nodes."""
    def run(batches):
        import pyarrow as pa

        kinds = [("group", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("hash", pa.string())]
        out = []
        for held, root, _ in _blocks(_listed(batches), bits, False):
            group, pos, n, _ = held[0][:4]
            out.append((group, pos >> bits, -(-n >> bits) if n > 1 << bits else 1, root))
            if len(out) >= 4096:
                yield _batch(out, kinds)
                out = []
        yield _batch(out, kinds)

    return _together(nodes, bits).select("group", "pos", "n", "hash").mapInArrow(run, "group string, pos long, n long, hash string")


def block_witnesses(nodes: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """``nodes`` with ``witness``, up to the top: the steps in their block and those of ``above`` (group, pos, witness), by block.

    Columns of nodes but group, pos, n and hash must be strings or longs.
    """
    more = [c for c in nodes.columns if c not in ("group", "pos", "n", "hash", "block")]
    columns = ["group", "pos", "n", "hash", *more]
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}

    def run(batches):
        import pyarrow as pa

        types = [(c, pa.int64() if kinds[c] == "bigint" else pa.string()) for c in columns] + [("witness", pa.string())]
        out = []
        for held, _, steps in _blocks(_listed(batches), bits, True):
            for row, own in zip(held, steps, strict=True):
                out.append((*row[:-1], " ".join(own + [row[-1]] if row[-1] else own)))
            if len(out) >= 4096:
                yield _batch(out, types)
                out = []
        yield _batch(out, types)

    top = above.select(F.col("group").alias("g__"), F.col("pos").alias("b__"), F.col("witness").alias("up__"))
    met = _together(nodes, bits).join(top, F.col("group").eqNullSafe(F.col("g__")) & (F.col("block") == F.col("b__")))
    ordered = met.sortWithinPartitions("group", "block", "pos").select(*columns, "up__")
    return ordered.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", witness string")


def _rounds(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """``nodes`` and the roots of each further round, the last of which has one node a group."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while most > 1 or len(out) == 1:
        out.append(cut(block_roots(out[-1], bits)))
        most = -(-most >> bits)
    return out


def _witnessed(rounds: list[DataFrame], bits: int, top: DataFrame) -> DataFrame:
    """The first round's nodes with whole witnesses; ``top`` has the last round's (group, pos, witness)."""
    for nodes in reversed(rounds[:-1]):
        top = block_witnesses(nodes, top, bits)
    return top


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang, pos (its place in its language), leaf, witness (see Forest; steps joined by blanks, up to the root), subroot, root, and ``carry``'s columns (strings or longs).

    Defined cases: languages stand by their UTF-8 bytes, null first; in a language rows ascend by
    doc_id, null first, those of one id by leaf; repeated rows are leaves of their own. A null field
    differs from an empty one. A lone leaf is its language's subroot and a lone subroot the root. An
    empty table has no rows and no root. Other columns are ignored.
    """
    carry = carry or {}
    own = {f"carry{i}__": c for i, c in enumerate(carry.values())}
    rows = docs.select(F.col("lang").cast("string").alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf({c: F.col(c) for c in LEAF_FIELDS}).alias("hash"), *[c.alias(n) for n, c in own.items()])
    leaves = numbered(rows, "group", [F.col("doc_id").asc_nulls_first(), F.col("hash")])
    rounds = _rounds(leaves, bits)
    # the languages' subroots are the leaves of the tree above them
    subroots = rounds[-1].select(F.lit("").alias("group"), F.col("group").alias("lang"), F.col("hash"))
    upper = _rounds(cut(numbered(subroots, "group", [F.col("lang").asc_nulls_first()])), bits)
    root = upper[-1].select("group", F.col("hash").alias("root"))  # one row
    top = _witnessed(upper, bits, upper[-1].select("group", "pos", F.lit("").alias("witness")))
    known = cut(top.join(root, "group").select("lang", F.col("hash").alias("subroot"), "root", "witness"))  # a row for each language
    made = _witnessed(rounds, bits, known.select(F.col("lang").alias("group"), F.lit(0).cast("long").alias("pos"), "witness"))
    met = made.join(known.select("lang", "subroot", "root"), F.col("group").eqNullSafe(F.col("lang")))
    return met.select("doc_id", "lang", "pos", F.col("hash").alias("leaf"), "witness", "subroot", "root", *[F.col(n).alias(c) for n, c in zip(own, carry, strict=True)])


def fold_column(hashed: Column, witness: Column) -> Column:
    """fold() of a leaf and a witness."""
    @F.pandas_udf("string")
    def folded(h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([fold(a, b) for a, b in zip(h, w, strict=True)])

    return folded(hashed, witness)


def proof_column(witness: Column) -> Column:
    """Digest of a witness's siblings, from the leaf up."""
    return F.sha2(F.regexp_replace(witness, "[LRS ]", ""), 256)


def tampered_check(docs: DataFrame, every: int = 7, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and folded_root with verified, by which rows whose crc32 of the decimal doc_id ``every`` divides show a tampered n_chars (one more; a null stays)."""
    fields = {c: F.col(c) for c in LEAF_FIELDS}
    forged = leaf(fields | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1})
    hit = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0)
    told = manifest(docs, {"shown": F.when(hit, forged)}, bits)
    folded = told.withColumns({"folded_root": fold_column(F.coalesce("shown", "leaf"), F.col("witness")), "proof_sha256": proof_column(F.col("witness"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
