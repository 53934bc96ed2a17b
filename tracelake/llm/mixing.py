"""Mixing sources to target token weights by entropy balancing.

Spark plan: the text is read once to count words; everything after works on a
(doc_id, source, size) table. Newton steps run on the (source, size) histogram of that table,
so a source that holds a third of all rows costs no more than its distinct sizes. The
per-source state stays a DataFrame; the driver sees none of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: No document is taken more often than this.
MOST = 3
#: Sums of rates are decimal, so that they don't depend on the order of the rows.
EXACT = "decimal(38,6)"


def _rate(lam: Column, size: Column) -> Column:
    """Exponentially tilted rate exp(lambda * size), capped at MOST; lambda is null where all are taken MOST times."""
    return F.when(lam.isNull(), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(lam * size, F.lit(5.0)))))


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: words, weight and target.

    ``sizes`` has source and size. Sources by code point, null last, weigh 1, 2, 3, repeating,
    and share all words; a target stops at MOST times its source's words and the excess is
    reshared by weight until no target is above. That end state is min(MOST * words,
    level * weight) with one common level, found by running sums in the order in which the
    sources saturate. The table has one row a source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by = by.withColumn("weight", (F.row_number().over(every) - 1) % 3 + 1)
    whole = Window.orderBy("saturates", F.col("source").asc_nulls_last())
    to_here, total = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("saturates", F.lit(float(MOST)) * F.col("source_size") / F.col("weight"))
    by = by.withColumn("left", F.sum("source_size").over(total) - MOST * F.coalesce(F.sum("source_size").over(to_here), F.lit(0)))
    by = by.withColumn("w_left", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(to_here), F.lit(0)))
    # with all sources before this one saturated, the level is left / w_left; the first source that stays below it sets the level
    by = by.withColumn("level", F.col("left") / F.col("w_left"))
    by = by.withColumn("level", F.min(F.when(F.col("saturates") >= F.col("level"), F.struct("saturates", "level"))).over(total)["level"])
    return by.select("source", "source_size", "source_rows", F.least(F.col("source_size") * float(MOST), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def tilt(hist: DataFrame, goals: DataFrame, tolerance: float = 1e-7, most_steps: int = 60) -> DataFrame:
    """goals with ``lam``, the dual variable of each source.

    Minimises the convex dual whose gradient is (words taken - target): Newton steps on the
    log of the words taken, kept inside a bracket that each step narrows. A source's distinct
    sizes are one array, sqrt(2 * words) of them at most, so all steps are one expression of
    one query, not several queries a step.
    """
    full = F.col("target") >= F.col("source_size") * float(MOST) * (1 - 1e-12)
    state = goals.withColumn("lam", F.when(full | (F.col("source_size") == 0), F.lit(None)).otherwise(F.lit(0.0)))
    sizes = hist.where("size > 0").groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("sizes"))
    zero = F.lit(0).cast(EXACT)

    def sums(lam: Column) -> Column:
        """g, the words taken, and h, their derivative by lambda."""
        def add(acc: Column, x: Column) -> Column:
            size = x["size"].cast("double")
            rate = _rate(lam, size)
            slope = F.when(rate < MOST, x["n"] * size * size * rate).otherwise(0.0)
            return F.struct((acc["g"] + (x["n"] * size * rate).cast(EXACT)).cast(EXACT).alias("g"), (acc["h"] + slope.cast(EXACT)).cast(EXACT).alias("h"))

        return F.aggregate("sizes", F.struct(zero.alias("g"), zero.alias("h")), add, lambda acc: F.struct(acc["g"].cast("double").alias("g"), acc["h"].cast("double").alias("h")))

    def step(now: Column, seen: Column) -> Column:
        g, h, lam, target = seen["g"], seen["h"], now["lam"], F.col("target")
        gap = F.log(g) - F.log(target)
        lo, hi = F.when(gap < 0, lam).otherwise(now["lo"]), F.when(gap > 0, lam).otherwise(now["hi"])
        newton, off = F.when(h > 0, lam - gap * g / h), F.abs(g / target - 1)
        new = F.when(off <= tolerance, lam).when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        return F.struct(new.alias("lam"), lo.alias("lo"), hi.alias("hi"), off.alias("off"))

    def stepped(now: Column, _: Column) -> Column:
        # the sums are an element of an array, so that they are taken once a step
        return F.when(now["off"] <= tolerance, now).otherwise(F.transform(F.array(sums(now["lam"])), lambda seen: step(now, seen))[0])

    begin = F.struct(F.lit(0.0).alias("lam"), F.lit(-60.0).alias("lo"), F.lit(1.2).alias("hi"), F.lit(1.0).alias("off"))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(most_steps)), begin, stepped)["lam"]
    state = cut(state.join(sizes, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("lam", F.when(F.col("lam").isNull(), F.col("lam")).otherwise(solved)).drop("s", "sizes"))
    return state.select("source", "source_size", "source_rows", "target", "lam")


def mix(docs: DataFrame, rows_per_group: int = 1500, repairs: int = 4, carry: list[str] | None = None) -> DataFrame:
    """Copies of each document so that every source's words come near its target.

    Rates are exp(lambda_source * size), at most MOST. They are rounded along each group's
    size order (a group is a slice of one source), so that rounding errors of neighbours in
    size cancel; then single documents, one a source and repair, gain or lose a copy to
    close what remains.

    Defined cases: null text has size 0 and is taken 0 words (one copy); a null source is the
    last source; a corpus without words has targets 0; repeated rows are rows of their own;
    an empty table gives an empty result; other columns are ignored, or kept if named in
    ``carry``. Reruns agree: sums are decimal, ties break by doc_id and then by a hash.

    Returns doc_id, size, source_size, target, taken, copies (and ``carry`` as kept_<name>).
    """
    names = carry or []
    carry = [f"carry_{i}" for i in range(len(names))]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("tie"), *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)])
    meta = cut(plain.select("doc_id", "source", "size", "tie")) if not carry else plain
    hist = cut(meta.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = hist.select("source", (F.col("size") * F.col("n")).alias("size"), "n")
    goals = targets(sizes)
    rows = hist.groupBy("source").agg(F.sum("n").alias("n_rows")).select(F.col("source").alias("s"), "n_rows")
    goals = goals.join(rows, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", F.col("n_rows").alias("source_rows"), "target")
    state = tilt(hist, goals)

    per = state.select(F.col("source").alias("s"), "source_size", "target", "lam", F.ceil(F.col("source_rows") / rows_per_group).alias("groups"))
    rated = meta.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rated = rated.withColumns({"part": F.pmod(F.xxhash64("tie"), F.greatest(F.col("groups"), F.lit(1))), "rate": _rate(F.col("lam"), F.col("size").cast("double"))})
    order = Window.partitionBy("source", "part").orderBy("size", "doc_id", "tie")
    run = F.sum("rate").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.pmod(F.xxhash64("source", "part"), F.lit(1000)) / F.lit(1000.0)
    rated = rated.withColumns({"upto": F.floor(F.round(run, 6) + start), "nth": F.row_number().over(order)})
    rated = rated.withColumn("copies", F.least(F.lit(MOST), F.col("upto") - F.coalesce(F.lag("upto").over(order), F.floor(start))))
    rated = rated.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("long"))
    rated = rated.select("doc_id", "source", "size", "source_size", "target", "part", "nth", "copies", *carry)
    small = cut(rated.drop(*carry))
    out = _repaired(rated if carry else small, _fixes(small, repairs), carry)
    return out.withColumnsRenamed({c: f"kept_{n}" for n, c in zip(names, carry, strict=True)})


def _fixes(rated: DataFrame, repairs: int) -> DataFrame | None:
    """One document of each source and round, the one nearest in size to what is missing or over, changes by a copy."""
    fixes = None
    left = cut(rated.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("got"), F.first("target").alias("target")).select(F.col("source").alias("s"), (F.col("target") - F.col("got")).alias("miss")).coalesce(1))
    for _ in range(repairs):
        free = rated.select("source", "part", "nth", "size", "copies", "doc_id").where("size > 0")
        if fixes is not None:
            free = free.join(fixes.select("source", "part", "nth").withColumnRenamed("source", "fs").withColumnsRenamed({"part": "fp", "nth": "fn"}), F.col("source").eqNullSafe(F.col("fs")) & (F.col("part") == F.col("fp")) & (F.col("nth") == F.col("fn")), "left_anti")
        fit = (F.col("size") < 2 * F.abs("miss")) & F.when(F.col("miss") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0)
        best = (
            free.join(left, F.col("source").eqNullSafe(F.col("s"))).where(fit)
            .groupBy("source").agg(F.min(F.struct(F.abs(F.abs("miss") - F.col("size")).alias("gap"), "part", "nth", "size", F.signum("miss").cast("long").alias("change"))).alias("b"))
            .select("source", "b.part", "b.nth", "b.size", "b.change")
        )
        best = cut(best.coalesce(1))
        if best.isEmpty():
            break
        fixes = best if fixes is None else fixes.unionByName(best)
        left = cut(left.join(best.select(F.col("source").alias("bs"), "size", "change"), F.col("s").eqNullSafe(F.col("bs")), "left").select("s", (F.col("miss") - F.coalesce(F.col("size") * F.col("change"), F.lit(0))).alias("miss")).coalesce(1))
    return fixes


def _repaired(rated: DataFrame, fixes: DataFrame | None, carry: list[str]) -> DataFrame:
    out = rated
    if fixes is not None:
        named = fixes.select(F.col("source").alias("fs"), F.col("part").alias("fp"), F.col("nth").alias("fn"), "change")
        out = out.join(named, F.col("source").eqNullSafe(F.col("fs")) & (F.col("part") == F.col("fp")) & (F.col("nth") == F.col("fn")), "left")
        out = out.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"), *carry)
