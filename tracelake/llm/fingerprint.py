"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame functions only.

A term counts if its inverse document frequency lies in a band. Document frequencies are
counted over all documents in a fixed table of 2**20 term-hash buckets, so the lexicon is a
bitmap of 128 kB however many terms the corpus has. A document's distinct terms in the band
are sorted and hashed once for each of 64 random lexicon subsets. At level L a subset holds
the share 2**-L of the lexicon; a document uses the level at which some 16 to 32 of its
terms fall into the subsets, and the next sparser one, so that texts of similar length share
a level. The whole lexicon is one more subset: every term in the band counts in its hash, so
texts of any length that differ in one such term differ in their fingerprints.

Spark plan: one pass counts frequencies (map-side combined on bucket numbers); one exchange
by ranges of doc_id brings each text beside the next document's. Both fingerprints, the next
document's fingerprint and the likenesses come from that one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BUCKET_BITS, SUBSETS = 20, 64
#: Terms in more than this share of the documents are out of the band, and so are those of a single document.
COMMON, RARE = 0.05, 2
#: With fewer terms in the band than this, all terms count.
FEW_TERMS = 4
EMPTY = "----"


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-cased letter and digit runs of a text."""
    runs = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(runs, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, common: float = COMMON, rare: int = RARE) -> DataFrame:
    """One row, lex: 2**BUCKET_BITS bits as array<long>; a set bit is a bucket within the band."""
    mask = F.lit((1 << BUCKET_BITS) - 1)
    # each partition counts its documents in a marker bucket, so one pass gives both numbers
    marks = F.array_append(F.array_distinct(F.transform(term_hashes(F.coalesce("text", F.lit(""))), lambda h: h.bitwiseAND(mask))), F.lit(-1).cast("long"))
    df = cut(docs.select(F.explode(marks).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    total = df.where("b = -1").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    band = df.where((F.col("b") >= 0) & (F.col("n") >= rare) & (F.col("n") <= max(rare, math.floor(common * total))))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))
    words = band.groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(one).alias("bits"))
    every = docs.sparkSession.range(0, 1 << (BUCKET_BITS - 6)).select(F.col("id").cast("int").alias("w"))
    dense = every.join(words, "w", "left").select("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return cut(dense.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda s: s["bits"]).alias("lex")))


def with_codes(df: DataFrame, text: str, lex: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: struct(level, whole, dense, sparse), the hash of all terms and the subset hashes at the text's level and the next.

    Steps are columns of their own, so that each is evaluated once a row.
    """
    h, kept, lev, whole = f"{name}_h", f"{name}_kept", f"{name}_level", f"{name}_whole"
    df = df.withColumns({h: term_hashes(F.col(text)), "lex": lex.scalar()})
    inside = lambda x: F.getbit(F.element_at("lex", (F.shiftright(x.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)), 6) + 1).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1
    df = df.withColumn(kept, F.filter(h, inside)).drop("lex")
    df = df.withColumn(kept, F.when(F.size(kept) >= FEW_TERMS, F.col(kept)).otherwise(F.col(h))).drop(h)
    df = df.withColumn(lev, (F.lit(6) + F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(kept), F.lit(1)) / F.lit(SUBSETS / 2))))).cast("int"))
    cell = lambda x, up: F.shiftrightunsigned(x, BUCKET_BITS).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(lev) + up) - 1)
    df = df.withColumn(whole, F.when(F.size(kept) == 0, EMPTY).otherwise(F.lpad(F.lower(F.hex(F.xxhash64(F.sort_array(kept)))), 16, "0")))
    df = df.withColumn(kept, F.filter(kept, lambda x: cell(x, 0) < SUBSETS))
    # by cell and then by term, so that a subset's terms are one slice of the array
    by, cells = [f"{name}_by{up}" for up in (0, 1)], [f"{name}_cells{up}" for up in (0, 1)]
    sorted_by = lambda up: F.array_sort(F.transform(kept, lambda x: F.struct(cell(x, up).alias("cell"), x.alias("term"))))
    df = df.withColumns({by[up]: sorted_by(up) for up in (0, 1)})
    df = df.withColumns({cells[up]: F.transform(by[up], lambda s: s["cell"]) for up in (0, 1)})

    def codes(up: int) -> Column:
        own = F.col(cells[up])

        def code(k: Column) -> Column:
            at = F.array_position(own, k)
            mine = F.slice(by[up], at.cast("int"), F.size(own) - F.size(F.array_remove(own, k)))["term"]
            return F.when(at == 0, EMPTY).otherwise(F.lpad(F.lower(F.hex(F.xxhash64(mine).bitwiseAND(F.lit(0xFFFF)))), 4, "0"))

        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS - 1).cast("long")), code)

    return df.withColumn(name, F.struct(F.col(lev).alias("level"), F.col(whole).alias("whole"), codes(0).alias("dense"), codes(1).alias("sparse"))).drop(kept, lev, whole, *by, *cells)


def as_string(codes: str, text: str) -> Column:
    """The fingerprint: level, hash of all terms and subset hashes; a text without terms has a hash of itself instead."""
    level, whole = F.lpad(F.col(f"{codes}.level").cast("string"), 2, "0"), F.col(f"{codes}.whole")
    told = F.concat_ws(":", level, whole, F.array_join(f"{codes}.dense", ""), F.array_join(f"{codes}.sparse", ""))
    return F.when(whole == EMPTY, F.concat(F.lit("text:"), F.hex(F.xxhash64(text)))).otherwise(told)


def likeness(a: str, b: str, string_a: Column, string_b: Column) -> Column:
    """Share of equal hashes among the subsets, the whole lexicon included, in which either text has terms; 1 for equal fingerprints."""
    la, lb = F.col(f"{a}.level"), F.col(f"{b}.level")
    left = F.when(la >= lb, F.col(f"{a}.dense")).otherwise(F.col(f"{a}.sparse"))
    right = F.when(lb >= la, F.col(f"{b}.dense")).otherwise(F.col(f"{b}.sparse"))
    left, right = F.array_append(left, F.col(f"{a}.whole")), F.array_append(right, F.col(f"{b}.whole"))
    # 66 a subset with terms, and 1 more where the hashes agree, added up in one pass
    unit = SUBSETS + 2
    votes = F.aggregate(F.zip_with(left, right, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), 0).when(x == y, unit + 1).otherwise(unit)), F.lit(0), lambda s, v: s + v)
    told, same = F.floor(votes / unit), votes % unit
    score = F.when(F.abs(la - lb) > 1, 0.0).otherwise(F.coalesce(same / F.nullif(told, F.lit(0)), F.lit(0.0)))
    return F.when(string_a == string_b, 1.0).otherwise(score).cast("double")


def _ranges(docs: DataFrame, rows_per_range: int) -> tuple[list[list[int]], int]:
    """Bounds of doc_id ranges of about equal rows, in two levels of at most 256, and the number of ranges."""
    n = docs.count()
    want = max(1, min(1 << 16, -(-n // rows_per_range)))
    coarse = math.ceil(math.sqrt(want))
    many = coarse * coarse
    got = docs.select(F.percentile_approx("doc_id", F.array(*[F.lit(i / many) for i in range(1, many)]), max(10_000, 4 * many)).alias("q")).first()["q"] if n and many > 1 else None
    bounds = sorted(set(got or []))
    return [bounds[i : i + coarse] for i in range(0, len(bounds), coarse)], len(bounds) + 1


def _range_of(groups: list[list[int]], value: Column) -> Column:
    """How many of all bounds are at most ``value``; null values get -1."""
    if not groups:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    longs = lambda xs: F.from_json(F.lit("[" + ",".join(map(str, xs)) + "]"), "array<bigint>")
    first = longs([g[0] for g in groups])
    fine = F.from_json(F.lit("[" + ",".join("[" + ",".join(map(str, g)) + "]" for g in groups) + "]"), "array<array<bigint>>")
    at = F.size(F.filter(first, lambda x: x <= value))
    inner = F.when(at > 0, F.size(F.filter(F.element_at(fine, F.greatest(at, F.lit(1))), lambda x: x <= value))).otherwise(0)
    return F.when(value.isNull(), F.lit(-1)).otherwise(F.greatest(at - 1, F.lit(0)) * len(groups[0]) + inner)


def edited_pairs(docs: DataFrame, rows_per_range: int = 1000) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likenesses.

    The edited text has its last floor(n/3) code points replaced by the first as many (or all)
    of the next document in descending doc_id; after the last comes the first.

    Defined cases: a null text is empty; an empty text or one without terms has a fingerprint
    of itself; a null doc_id comes last; documents with one doc_id are ordered by a hash of the
    text and then by the text; a single document is its own next; an empty table gives an
    empty result; columns beyond doc_id and text are ignored.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    groups, _ = _ranges(plain.select("doc_id"), rows_per_range)
    ranged = plain.select("doc_id", "text", _range_of(groups, F.col("doc_id")).cast("int").alias("part"), F.xxhash64("text").alias("tie"))
    lex = lexicon(plain)
    # the first row of each range also stands, as a guest, at the end of the range before it
    firsts = cut(ranged.groupBy("part").agg(F.max(F.struct("doc_id", F.negative("tie").alias("t"))).alias("f")).select("part", "f.doc_id", (-F.col("f.t")).alias("tie")))
    heads = sorted((r["part"], r["doc_id"], r["tie"]) for r in firsts.collect())  # at most 2**16 + 1 rows
    host = {heads[i][0]: heads[i + 1][0] if i + 1 < len(heads) else heads[0][0] for i in range(len(heads))}
    order = [F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("text")]
    if heads:
        hosts = docs.sparkSession.createDataFrame([(p, d, t, host[p]) for p, d, t in heads], "p int, d long, t long, host int")
        guests = ranged.join(hosts, (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("doc_id", "text", F.col("host").alias("part"), "tie", F.lit(1).alias("guest")).dropDuplicates(["part"])
        ranged = ranged.withColumn("guest", F.lit(0)).unionByName(guests)
    else:
        ranged = ranged.withColumn("guest", F.lit(0))
    in_range = Window.partitionBy("part").orderBy(*order)
    rows = ranged.withColumn("next", F.lead("text").over(in_range))
    k = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.length("text") - k), F.left(F.coalesce("next", F.lit("")), k))).drop("next")
    rows = with_codes(rows, "text", lex, "own")
    rows = with_codes(rows, "edited", lex, "alt")
    rows = rows.withColumns({"fingerprint": as_string("own", "text"), "edited_fingerprint": as_string("alt", "edited"), "n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)}).drop("edited")
    rows = rows.withColumn("after", F.lead(F.struct("own", "fingerprint")).over(in_range))
    rows = rows.where("guest = 0").withColumns({"nxt": F.col("after.own"), "nxt_fp": F.col("after.fingerprint")})
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("own", "alt", F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness("own", "nxt", F.col("fingerprint"), F.col("nxt_fp")).alias("near_next"))
