"""What stands behind the pipe of a Sigma condition: aggregation and ``near`` within a time frame.

``| count(field) by key > n`` holds at an event if, of the events that the search takes, those of
its key within the time frame up to it are more than n (without a field: events; with one:
distinct values). ``sum(field)`` and ``avg(field)`` work alike. ``| near a and not b`` holds at an event of
the search if, on its host, an event of ``a`` and none of ``b`` lies within the time frame before or
after it.

Both are asked of one sweep. An event counts over an interval of time (until the time frame is over or,
for distinct values, its value comes again); the interval's begin and end are a plus and a minus,
and the running sum up to a time is what is counted there. So a window is never listed again for each
of its rows. Time is cut into slots, longer than the time frame; intervals and questions are dealt to the
slots that they lie in, so a key with very many events is many tasks'. All rules share the scan and
the sweep.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import any_of

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "==": lambda a, b: a == b}
#: Time frames of a slot.
SLOT = 16
_AGGREGATE = re.compile(r"(count|sum|avg|min|max)\s*\(\s*([^()\s]*)\s*\)\s*(?:by\s+([^<>=]+?)\s*)?(>=|<=|==|=|>|<)\s*(-?\d+(?:\.\d+)?)", re.I)


class Unsupported(ValueError):
    """A pipe that isn't translated, and why."""


@dataclass
class Timed:
    """A compiled pipe: ``micros`` of its time frame and either an aggregation or what must, and must not, be near."""

    text: str
    micros: int
    function: str = ""
    #: The field that is counted or summed, as our name of it; none counts events.
    value: str | None = None
    by: tuple[str, ...] = ()
    compare: str = ""
    limit: float = 0
    #: (predicate, whether it must hold near the event).
    near: tuple[tuple[Column, bool], ...] = ()


def micros_of(frame) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", str(frame))
    if not m or not int(m[1]):
        raise Unsupported(f"time frame {frame}")
    return int(m[1]) * UNITS[m[2]] * 1_000_000


def _parsed(pipe: str):
    if m := _AGGREGATE.fullmatch(pipe.strip()):
        function, value, by, compare, limit = m[1].lower(), m[2] or None, m[3], m[4], float(m[5])
        if function in ("min", "max"):
            raise Unsupported(f"aggregation by {function}")
        if function != "count" and value is None:
            raise Unsupported(f"{function} without a field")
        return function, value, tuple(x for x in re.split(r"[,\s]+", by or "") if x), compare, limit
    return None


def fields_behind_pipe(condition: str) -> list[str]:
    """The document's names of the fields that an aggregation reads."""
    found = _parsed(condition.partition("|")[2]) if "|" in condition else None
    return [] if found is None else [*([found[1]] if found[1] else []), *found[2]]


def compile_timed(pipe: str, frame, names: dict[str, str], predicate: Callable[[str], Column], selections: list[str]) -> Timed:
    """The pipe of a condition; ``predicate`` compiles a selection by name."""
    if frame is None:
        raise Unsupported("aggregation without a time frame")
    micros = micros_of(frame)
    if found := _parsed(pipe):
        function, value, by, compare, limit = found
        return Timed(f"{pipe} in {frame}", micros, function, value and names[value], tuple(names[b] for b in by), compare, limit)
    words = pipe.split()
    if not words or words[0].lower() != "near":
        raise Unsupported(f"pipe {pipe}")
    near, wanted = [], True
    expect = True
    for w in words[1:]:
        if w.lower() == "and" and not expect:
            expect, wanted = True, True
        elif w.lower() == "not" and expect and wanted:
            wanted = False
        elif expect and w in selections:
            near.append((predicate(w), wanted))
            expect = False
        else:
            raise Unsupported(f"near with {w}")
    if expect:
        raise Unsupported("near without a selection")
    return Timed(f"{pipe} in {frame}", micros, near=tuple(near))


def sweep(intervals: DataFrame, questions: DataFrame, keys: list[str], amounts: list[str]) -> DataFrame:
    """``questions`` (keys, t, span, own columns) with the sums of ``amounts`` over the ``intervals`` (keys, begin, end, span, amounts) of its key that hold its time: begin <= t < end.

    ``span`` is the time frame of the key's rule; no interval is longer than twice that.
    """
    slot = lambda at: F.floor(at / (F.col("span") * SLOT)).cast("long")
    own = [c for c in questions.columns if c not in (*keys, "t", "span")]
    begun = intervals.where("begin < end").withColumn("slot", F.explode(F.sequence(slot(F.col("begin")), slot(F.col("end") - 1))))
    edges = begun.select(*keys, "slot", F.explode(F.array(F.struct(F.col("begin").alias("t"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("sign")))).alias("e"), *amounts)
    edges = edges.select(*keys, "slot", "e.t", *[(F.col(a) * F.col("e.sign")).alias(a) for a in amounts], F.lit(None).cast(questions.select(F.struct(*own)).schema[0].dataType).alias("own"))
    asked = questions.select(*keys, slot(F.col("t")).alias("slot"), "t", *[F.lit(0).cast(intervals.schema[a].dataType).alias(a) for a in amounts], F.struct(*own).alias("own"))
    # all edges at a time count before a question at that time: the frame takes rows of equal time together
    upto = Window.partitionBy(*keys, "slot").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return edges.unionByName(asked).withColumns({f"sum_{a}": F.sum(a).over(upto) for a in amounts}).where(F.col("own").isNotNull()).select(*keys, "t", "own.*", *[F.coalesce(f"sum_{a}", F.lit(0)).alias(a) for a in amounts])


def _taken(artifacts: DataFrame, found: list[tuple], fields, row: Callable[[int, tuple], Column]) -> DataFrame:
    """(artifact_id, case_id, host, t, hit) of the rules' events with a time: one scan, one row for each rule that takes the event."""
    scopes = [r[1] for r in found]
    scope = any_of([F.lit(True) if not types else any_of([F.col("artifact_type").startswith(t) for t in types]) for types in dict.fromkeys(scopes)])
    timed = artifacts.withColumn("t__", F.unix_micros(F.try_to_timestamp("timestamp_utc"))).where(F.col("t__").isNotNull() & scope)
    host = "host" if "host" in artifacts.columns else F.lit(None).cast("string").alias("host")
    hits = [row(i, r) for i, r in enumerate(found)]
    chunks = [F.array_compact(F.array(*hits[k : k + 64])) for k in range(0, len(hits), 64)]
    return fields.project(timed).select("artifact_id", "case_id", host, F.col("t__").alias("t"), F.explode(F.concat(*chunks) if len(chunks) > 1 else chunks[0]).alias("hit"))


def _scoped(types: tuple[str, ...], test: Column) -> Column:
    return test if not types else any_of([F.col("artifact_type").startswith(t) for t in types]) & test


def counted(artifacts: DataFrame, found: list[tuple], fields) -> DataFrame:
    """(artifact_id, case_id, rule_id, matched_on, value) of aggregations, at each event where they hold. ``found`` has (rule id, types, predicate, Timed)."""
    def row(i: int, r: tuple) -> Column:
        _, types, test, t = r
        key = F.to_json(F.struct(*[fields.raw(b).alias(f"k{j}") for j, b in enumerate(t.by)])) if t.by else F.lit("")
        value = fields.raw(t.value) if t.value else F.lit(None).cast("string")
        said = F.concat_ws(" ", F.lit(t.text), *[F.concat(F.lit(f"{b}="), F.substring(fields.raw(b), 1, 200)) for b in t.by])
        return F.when(_scoped(types, test), F.struct(F.lit(i).alias("rule"), F.lit(t.micros).cast("long").alias("span"), F.lit(t.function == "count" and t.value is not None).alias("distinct"), key.alias("key"), value.alias("value"), said.alias("said")))

    events = _taken(artifacts, found, fields, row).select("artifact_id", "case_id", "t", "hit.*")
    # a distinct value must be there; a summed one must be a number
    events = events.withColumn("number", F.when(~F.col("distinct"), F.replace("value", F.lit(","), F.lit("")).try_cast("decimal(24,6)")))
    kept = events.where(~F.col("distinct") | (F.col("value") != ""))
    keys = ["rule", "case_id", "key"]
    ends = F.col("t") + F.col("span")
    plain = kept.where(~F.col("distinct")).withColumn("end", ends)
    # a value's next event may lie in the next slot: each event is also shown to the slot in which its time frame back from it begins
    slot = lambda at: F.floor(at / (F.col("span") * SLOT)).cast("long")
    shown = kept.where("distinct").withColumn("home", slot(F.col("t"))).withColumn("slot", F.explode(F.array_distinct(F.array(slot(F.col("t") - F.col("span")), F.col("home")))))
    next_time = F.lead("t").over(Window.partitionBy(*keys, "value", "slot").orderBy("t", "artifact_id"))
    once = shown.withColumn("next", next_time).where("slot = home").withColumn("end", F.least(F.coalesce("next", ends), ends)).drop("home", "slot", "next")
    intervals = plain.unionByName(once).select(*keys, F.col("t").alias("begin"), "end", "span", F.lit(1).cast("long").alias("n"), F.coalesce("number", F.lit(0)).cast("decimal(24,6)").alias("total"), F.col("number").isNotNull().cast("long").alias("numbers"))
    swept = sweep(intervals, events.select(*keys, "t", "span", "artifact_id", "said"), keys, ["n", "total", "numbers"])
    tests = []
    for i, (rule_id, _, _, t) in enumerate(found):
        value = F.col("n").cast("double") if t.function == "count" else F.col("total").cast("double") if t.function == "sum" else F.try_divide(F.col("total").cast("double"), F.col("numbers").cast("double"))
        tests.append((F.col("rule") == i, rule_id, value, COMPARE[t.compare](value, F.lit(t.limit))))

    def pick(k: int) -> Column:
        """What the event's rule has at ``k``."""
        case = F
        for t in tests:
            case = case.when(t[0], F.lit(t[k]) if k == 1 else t[k])
        return case

    return swept.where(pick(3)).select("artifact_id", "case_id", pick(1).alias("rule_id"), F.col("said").alias("matched_on"), pick(2).alias("value"))


NEAR_EVENT = "rule int, case_id string, host string, t long, artifact_id string, base boolean, mask long"


def near_events(artifacts: DataFrame, found: list[tuple], fields) -> DataFrame:
    """NEAR_EVENT rows: an event that a rule's search takes (``base``) or that one of its near selections does (bit i of ``mask``)."""
    def row(i: int, r: tuple) -> Column:
        _, types, test, t = r
        bits = [F.when(p, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, (p, _) in enumerate(t.near)]
        mask = reduce(lambda a, b: a.bitwiseOR(b), bits)
        return F.when(_scoped(types, test | (mask != 0)), F.struct(F.lit(i).alias("rule"), F.coalesce(test, F.lit(False)).alias("base"), mask.alias("mask")))

    taken = _taken(artifacts, found, fields, row)
    return taken.select("hit.rule", "case_id", "host", "t", "artifact_id", "hit.base", "hit.mask")


def near(artifacts: DataFrame, found: list[tuple], fields) -> DataFrame:
    """(artifact_id, case_id, rule_id, matched_on) of ``near`` rules, at each event of the search where they hold; events without a time take no part."""
    spark = artifacts.sparkSession
    told = spark.createDataFrame([(i, rule_id, t.micros, t.text, k, 1 << k, wanted) for i, (rule_id, _, _, t) in enumerate(found) for k, (_, wanted) in enumerate(t.near)], "rule int, rule_id string, span long, text string, part int, bit long, wanted boolean")  # a row for each rule's selection
    events = near_events(artifacts, found, fields).join(F.broadcast(told), "rule")
    keys = ["rule", "part", "case_id", "host"]
    seen = events.where(F.col("mask").bitwiseAND(F.col("bit")) != 0).select(*keys, (F.col("t") - F.col("span")).alias("begin"), (F.col("t") + F.col("span") + 1).alias("end"), "span", F.lit(1).cast("long").alias("n"))
    asked = events.where("base").select(*keys, "t", "span", "artifact_id", "rule_id", "text", "wanted")
    swept = sweep(seen, asked, keys, ["n"])
    # one answer for each selection: the event is told if all are as wanted
    all_as_wanted = swept.groupBy("artifact_id", "case_id", "rule", "rule_id", "text", "t").agg(F.bool_and((F.col("n") > 0) == F.col("wanted")).alias("holds"))
    return all_as_wanted.where("holds").select("artifact_id", "case_id", "rule_id", F.col("text").alias("matched_on"))


def detect(artifacts: DataFrame, found: list[tuple], fields) -> DataFrame:
    """(artifact_id, case_id, rule_id, matched_on) of rules with a pipe."""
    sums, nears = [r for r in found if not r[3].near], [r for r in found if r[3].near]
    parts = ([counted(artifacts, sums, fields).drop("value")] if sums else []) + ([near(artifacts, nears, fields)] if nears else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
