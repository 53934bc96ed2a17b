"""Sigma documents as rules of our own language: files to read, review and keep.

A condition is any boolean tree over selections; a rule has a block that must hold and exclusions that must
not. So the tree is brought into alternatives, each a set of selections that must hold and one of
selections that must not. Alternatives without exclusions share one rule, each other is a rule of its
own (``<id>``, ``<id>-2``, ...). The number of alternatives is bounded; what doesn't fit, or what
our language can't say, is refused with a reason.

Documents are program text and are translated on the driver; what is written goes through Spark.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.plans import sigma
from tracelake.plans.rules import DEEPEST
from tracelake.plans.sigma import Refused

#: Alternatives of a condition.
MOST = 64
#: Sigma's comparison -> our operator for any of some values, and for all of them where we have one.
OPERATORS = {"equals": ("equals_any", None), "contains": ("contains_any", "contains_all"), "startswith": ("startswith_any", None), "endswith": ("endswith_any", None)}
Alternative = tuple[frozenset[str], frozenset[str]]


def alternatives(tree, negated: bool = False) -> set[Alternative]:
    """A condition's tree as alternatives of (selections that hold, selections that don't); Refused beyond MOST."""
    kind = tree[0]
    if kind == "name":
        return {(frozenset(), frozenset([tree[1]]))} if negated else {(frozenset([tree[1]]), frozenset())}
    if kind == "not":
        return alternatives(tree[1], not negated)
    if kind == "of":
        least, names = tree[1], tree[2]
        need = len(names) - least + 1 if negated else least  # so many fail if fewer than ``least`` hold
        some = {frozenset(c) for c in _subsets(names, need)}
        return _fitting({(frozenset(), s) if negated else (s, frozenset()) for s in some})
    parts = [alternatives(t, negated) for t in tree[1]]
    if (kind == "or") != negated:
        return _fitting(set().union(*parts))
    out: set[Alternative] = {(frozenset(), frozenset())}
    for p in parts:
        out = _fitting({(a | c, b | d) for (a, b), (c, d) in product(out, p)})
    return out


def _subsets(names: list[str], n: int):
    from itertools import combinations, islice

    found = list(islice(combinations(names, n), MOST + 1))
    if len(found) > MOST:
        raise Refused(f"more than {MOST} alternatives")
    return found


def _fitting(found: set[Alternative]) -> set[Alternative]:
    """Without those that contradict themselves, and those that another one covers."""
    sound = {a for a in found if not a[0] & a[1]}
    least = {a for a in sound if not any(b != a and b[0] <= a[0] and b[1] <= a[1] for b in sound)}
    if len(least) > MOST:
        raise Refused(f"more than {MOST} alternatives")
    return least


def _condition(key: str, values, names: dict[str, str]) -> dict:
    field, *modifiers = key.split("|")
    field, values = names.get(field, field), values if isinstance(values, list) else [values]
    every = "all" in modifiers
    kinds = [m for m in modifiers if m != "all"]
    if len(kinds) > 1 or (kinds and kinds[0] not in (*OPERATORS, "re", "exists", "gt", "lt")):
        raise Refused(f"modifier {' '.join(kinds)} in a stored rule")
    kind = kinds[0] if kinds else "equals"
    if kind in ("exists", "gt", "lt"):
        return {"field": field, kind: values[0]}
    parts = []
    plain = [sigma._plain(str(v)) for v in values if v is not None and kind != "re" and not sigma._wild(str(v))]
    if plain and (not every or len(plain) == 1 or OPERATORS[kind][1]):
        parts.append({"field": field, (OPERATORS[kind][1] if every and len(plain) > 1 else OPERATORS[kind][0]): plain})
    elif plain:
        parts += [{"field": field, OPERATORS[kind][0]: [v]} for v in plain]
    for v in values:
        if v is None:
            parts.append({"field": field, "exists": False})
        elif kind == "re":
            parts.append({"field": field, "regex": str(v)})
        elif pattern := sigma._wild(str(v).lower()):
            before, after = (".*" if kind in ("contains", "endswith") else ""), (".*" if kind in ("contains", "startswith") else "")
            parts.append({"field": field, "regex": f"(?is)^{before}{pattern}{after}$"})
    return parts[0] if len(parts) == 1 else {"all" if every else "any": parts}


def _block(selection, names: dict[str, str]) -> dict:
    if sigma._keywords(selection) is not None:
        raise Refused("keywords in a stored rule")
    if isinstance(selection, list):
        return {"any": [_block(s, names) for s in selection]}
    return {"all": [_condition(k, v, names) for k, v in selection.items()]}


def _depth(block) -> int:
    if isinstance(block, list):
        return max(map(_depth, block), default=0)
    inner = [*(block.get("all") or []), *(block.get("any") or [])] if "all" in block or "any" in block else []
    return 1 + _depth(inner) if inner else 0


def stored_rules(doc: dict, names: dict[str, str] | None = None) -> list[dict]:
    """The rule documents of a Sigma document, in the scope and under the guards of its log source."""
    source = sigma.log_source(doc)
    detection = {k: v for k, v in (doc.get("detection") or {}).items() if k not in ("condition", "timeframe")}
    conditions = sigma._conditions(doc)
    if not conditions or any("|" in c for c in conditions):
        raise Refused("aggregation in a stored rule" if conditions else "no condition")
    tree = sigma.parse_condition(" or ".join(f"({c})" for c in conditions), list(detection))
    own = sigma._own_names(doc, names or {}, source.prefix)
    found = alternatives(tree)
    if not found:
        raise Refused("condition that never holds")
    blocks = {n: _block(s, own) for n, s in detection.items() if any(n in a | b for a, b in found)}
    guards = [{"field": f, "equals_any": list(v)} for f, v in source.guards]
    held = lambda a: {"all": [blocks[n] for n in sorted(a)]} if a else {"field": "artifact_type", "exists": True}
    free = sorted((a for a, b in found if not b), key=sorted)
    rest = sorted(((a, b) for a, b in found if b), key=lambda x: (sorted(x[0]), sorted(x[1])))
    bodies = [([held(free[0]) if len(free) == 1 else {"any": [held(a) for a in free]}], [])] if free else []
    bodies += [([held(a)], [blocks[n] for n in sorted(b)]) for a, b in rest]
    severity, score = sigma.LEVELS.get(doc.get("level", "medium"), sigma.LEVELS["medium"])
    attack = [t.removeprefix("attack.").upper() for t in doc.get("tags") or [] if re.fullmatch(r"attack\.t\d{4}(\.\d{3})?", str(t).lower())]
    base, out = sigma.stable_id(str(doc.get("id") or doc.get("title"))), []
    for i, (match, exclude) in enumerate(bodies, 1):
        one = {"id": base if i == 1 else f"{base}-{i}", "title": str(doc.get("title")), "severity": severity, "score": score, "attack": attack, "scope": {"artifact_type": list(source.types)}, "match": {"all": [*guards, *match]}}
        if exclude:
            one["exclude"] = exclude
        if _depth([one["match"], *exclude]) > DEEPEST:
            raise Refused("blocks nested too deep")
        out.append(one)
    return out


def translate(found: list[tuple[str, dict]], names: dict[str, str] | None = None) -> tuple[list[dict], list[tuple[str, str, str]]]:
    """(rule documents, refused (path, id, reason)) of sigma.read_corpus()'s documents; an id that came before is refused."""
    out, refused, seen = [], [], set()
    for path, doc in found:
        told = str(doc.get("id") or doc.get("title"))
        try:
            made = stored_rules(doc, names)
            if made[0]["id"] in seen:
                raise Refused("repeated id")
            seen.add(made[0]["id"])
            out += made
        except Refused as e:
            refused.append((path, told, str(e)))
    return out, refused


def worksheet(spark: SparkSession, written: list[dict]) -> DataFrame:
    """What a reviewer goes through: rule_id, title, severity, techniques, scope, exclusions (how many) and an empty ``verdict``."""
    rows = [(r["id"], r["title"], r["severity"], ", ".join(r["attack"]), ", ".join(r["scope"]["artifact_type"]), len(r.get("exclude", []))) for r in written]
    return spark.createDataFrame(rows, "rule_id string, title string, severity string, techniques string, scope string, exclusions int").withColumn("verdict", F.lit(""))


def write(spark: SparkSession, written: list[dict], refused: list[tuple[str, str, str]], folder: str) -> None:
    """Below ``folder``: ``rules`` (a YAML file for each severity, which rules.read_rules() reads), ``refused`` and ``worksheet`` (CSV), and ``manifest`` (JSON: rules, refused, and rules by severity)."""
    import yaml

    by: dict[str, list[dict]] = {}
    for r in written:
        by.setdefault(r["severity"], []).append(r)
    for severity, some in by.items():
        text = yaml.safe_dump_all(some, sort_keys=False, allow_unicode=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{folder}/rules/{severity}.yaml")
    spark.createDataFrame(refused, "path string, id string, reason string").coalesce(1).write.mode("overwrite").csv(f"{folder}/refused", header=True)
    worksheet(spark, written).coalesce(1).write.mode("overwrite").csv(f"{folder}/worksheet", header=True)
    counts = spark.createDataFrame([(len(written), len(refused), {s: len(x) for s, x in by.items()})], "rules int, refused int, by_severity map<string,int>")
    counts.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> list:
    """The rules that write() wrote."""
    from tracelake.plans import rules

    files = spark.read.text(f"{folder}/rules/*.yaml", wholetext=True).select("_metadata.file_path", "value")
    return rules.load_rules(r["value"] for r in files.orderBy("file_path").toLocalIterator())
