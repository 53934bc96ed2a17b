"""Which condition of a rule makes it noisy.

Each row in a rule's scope becomes a mask: a bit for each of the rule's conditions that holds there,
and one for each whose field is filled. The rows are counted by mask, in one scan for all rules. All
else follows from these counts, which are few: how many rows a condition takes, how many the
rule matches, and how many it would match if a condition were left out.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import all_of, any_of
from tracelake.plans import rules

#: Conditions of a rule: as many as a mask has bits.
MOST = 62


def _tree(block, leaves: list[dict]):
    """A block as ("leaf", i), ("all", parts) or ("any", parts); its conditions are put on ``leaves``."""
    if isinstance(block, (list, tuple)):
        return ("all", [_tree(b, leaves) for b in block])
    if "all" not in block and "any" not in block:
        leaves.append(block)
        return ("leaf", len(leaves) - 1)
    parts = [_tree(b, leaves) for b in block.get("all") or []]
    some = [_tree(b, leaves) for b in block.get("any") or []]
    return ("all", [*parts, *([("any", some)] if some else [])])


def _holds(tree, bit, without: int | None) -> Column | None:
    """Whether a tree holds on a mask, one condition left out; null if nothing is left of it."""
    kind, inner = tree
    if kind == "leaf":
        return None if inner == without else bit(inner)
    parts = [p for p in (_holds(t, bit, without) for t in inner) if p is not None]
    return (all_of if kind == "all" else any_of)(parts) if parts else None


def conditions(artifacts: DataFrame, which: list[rules.Rule]) -> DataFrame:
    """A row for each condition of each rule: rule_id, nth (from 0, in the order written, exclusions last), part (`match` or `exclude`), condition (as JSON), holds (rows in scope that it takes), filled (rows in scope whose field isn't empty), seen (rows in scope), matched (rows that the rule matches), without (rows that it would match without the condition).

    A rule without rows in its scope has no counts and is left out; one with more than MOST conditions is refused.
    """
    fields = rules.Fields(n for r in which for n in rules.fields_of(r))
    told, hits = [], []
    for k, r in enumerate(which):
        leaves: list[dict] = []
        match = _tree(r.match, leaves)
        n_match = len(leaves)
        exclude = [_tree(x, leaves) for x in r.exclude]
        if len(leaves) > MOST:
            raise rules.RuleError(f"rule {r.id}: more than {MOST} conditions")
        told.append((r, leaves, n_match, match, exclude))
        mask = lambda tests: reduce(lambda a, b: a.bitwiseOR(b), [F.when(t, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, t in enumerate(tests)])
        takes = mask([rules.compile_condition(c, fields)[0] for c in leaves])
        filled = mask([fields.raw(str(c["field"])) != "" for c in leaves])
        hits.append(F.when(rules.in_scope(r, F.col("artifact_type")), F.struct(F.lit(k).alias("k"), takes.alias("takes"), filled.alias("filled"))))
    masks = fields.project(artifacts).select(F.explode(F.array_compact(F.array(*hits))).alias("m")).groupBy("m.k", "m.takes", "m.filled").agg(F.count(F.lit(1)).alias("n"))

    def rows_of(r: rules.Rule, leaves: list[dict], n_match: int, match, exclude) -> Column:
        bit = lambda i: F.col("takes").bitwiseAND(F.lit(1 << i).cast("long")) != 0

        def whole(without: int | None) -> Column:
            out = [p for p in (_holds(x, bit, without) for x in exclude) if p is not None]
            taken = _holds(match, bit, without)
            return (F.lit(True) if taken is None else taken) & (~any_of(out) if out else F.lit(True))

        said = lambda c: json.dumps(c, sort_keys=True, ensure_ascii=False)
        return F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(i).alias("nth"), F.lit("match" if i < n_match else "exclude").alias("part"), F.lit(said(c)).alias("condition"), bit(i).alias("holds"), (F.col("filled").bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias("full"), whole(None).alias("matched"), whole(i).alias("without")) for i, c in enumerate(leaves)])

    case = F
    for k, one in enumerate(told):
        case = case.when(F.col("k") == k, rows_of(*one))
    every = masks.select("n", F.explode(case).alias("c"))
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c.rpartition(".")[2])
    return every.groupBy("c.rule_id", "c.nth", "c.part", "c.condition").agg(count("c.holds"), count("c.full").alias("filled"), F.sum("n").alias("seen"), count("c.matched"), count("c.without"))
