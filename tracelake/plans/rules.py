"""The rule language: boolean rules compiled to Catalyst columns.

A rule has id, title and match, and optionally severity, score, attack, scope
({artifact_type: [..], exact: bool}) and exclude. A condition names a field and operators; a
block is a list (all of it) or a mapping with ``all`` and/or ``any``, nested at most six
deep. A row matches when no exclude item is true and the match block is.

All rules of a scope share one scan. Each field that any rule reads is extracted and
lower-cased once; rules that ask for one value of a guard field are nested under a CASE on
it, so that most rows never reach their conditions. Every predicate is null-safe: a missing
field is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import all_of, any_of
from tracelake.model import DEFAULT_SCORE, SEVERITIES
from tracelake.plans.literals import MANY, Literals

TOP_LEVEL = ("description", "artifact_type", "host", "timestamp_utc", "primary_ts_type", "source")
#: The field that stands for all text of an artifact: its description and raw data.
ALL_TEXT = "*"
OPERATORS = ("equals", "equals_any", "contains", "contains_any", "contains_all", "startswith_any", "endswith_any", "regex", "exists", "is_true", "gt", "lt")
DEEPEST = 6
#: Fields whose value picks a rule's group.
GUARDS = ("raw_data.EventId", "raw_data.Channel", "artifact_type")
#: Rules whose hits are one array of a row's expressions; more would outgrow generated code.
CHUNK = 64


class RuleError(ValueError):
    """A rule that can't be compiled."""


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    match: object
    severity: str = "medium"
    score: int | None = None
    attack: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    exact: bool = False
    exclude: tuple = field(default=(), hash=False)

    @property
    def points(self) -> int:
        return DEFAULT_SCORE[self.severity] if self.score is None else self.score


def rule_from(doc: dict) -> Rule:
    """A rule from its YAML document."""
    missing = [k for k in ("id", "title", "match") if not doc.get(k)]
    if missing:
        raise RuleError(f"rule {doc.get('id')}: missing {', '.join(missing)}")
    severity = doc.get("severity", "medium")
    if severity not in SEVERITIES:
        raise RuleError(f"rule {doc['id']}: no severity {severity}")
    scope = doc.get("scope") or {}
    types = scope.get("artifact_type") or ()
    types = (types,) if isinstance(types, str) else tuple(types)
    exclude = doc.get("exclude") or ()
    return Rule(str(doc["id"]), doc["title"], doc["match"], severity, doc.get("score"), tuple(doc.get("attack") or ()), types, bool(scope.get("exact")), tuple(exclude) if isinstance(exclude, (list, tuple)) else (exclude,))


def load_rules(texts: Iterable[str]) -> list[Rule]:
    """Rules of YAML texts of one or more documents (a document may be a list); an id may occur once, and so may a key of a mapping."""
    import yaml

    class Strict(yaml.SafeLoader):
        """Two equal keys in a mapping would silently hide a rule."""

    def mapping(loader, node):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        twice = {k for k in keys if keys.count(k) > 1}
        if twice:
            raise RuleError(f"repeated keys {sorted(map(str, twice))}")
        return yaml.SafeLoader.construct_mapping(loader, node, deep=True)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    rules: dict[str, Rule] = {}
    for text in texts:
        for doc in yaml.load_all(text, Strict):
            for one in doc if isinstance(doc, list) else [doc] if doc else []:
                rule = rule_from(one)
                if rule.id in rules:
                    raise RuleError(f"duplicate id {rule.id}")
                rules[rule.id] = rule
    return list(rules.values())


# --- fields -------------------------------------------------------------------------------------------

def conditions_of(block) -> Iterable[dict]:
    """All conditions within a block."""
    if isinstance(block, (list, tuple)):
        for x in block:
            yield from conditions_of(x)
    elif isinstance(block, dict) and ("all" in block or "any" in block):
        yield from conditions_of(block.get("all") or [])
        yield from conditions_of(block.get("any") or [])
    elif isinstance(block, dict):
        yield block


def fields_of(rule: Rule) -> list[str]:
    return sorted({str(c["field"]) for c in [*conditions_of(rule.match), *conditions_of(list(rule.exclude))] if "field" in c})


def _parts(path: str) -> list[str]:
    return path.split(".")


def field_value(name: str, variant: Column | None = None) -> Column:
    """A field as text: a top-level column, or a dotted path into raw_data."""
    if name in TOP_LEVEL:
        return F.col(name).cast("string")
    path = _parts(name.removeprefix("raw_data."))
    quoted = "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in path)
    return F.try_variant_get(F.try_parse_json("raw_data") if variant is None else variant, quoted, "string")


class Fields:
    """Names of the columns that hold the fields' texts (``raw``) and their lower-cased form (``low``)."""

    def __init__(self, names: Iterable[str]):
        self.at = {n: i for i, n in enumerate(dict.fromkeys(names))}
        self.searches: dict[str, Literals] = {}
        self.columns: dict[str, Column] = {}

    def _column(self, name: str) -> Column:
        """A column by name, made once: thousands of conditions refer to it."""
        if name not in self.columns:
            self.columns[name] = F.col(name)
        return self.columns[name]

    def raw(self, name: str) -> Column:
        return self._column(f"f{self.at[name]}__")

    def low(self, name: str) -> Column:
        return self._column(f"l{self.at[name]}__")

    def said(self, name: str) -> Column:
        """What to say about a field that matched: its name and the text's first 200 characters."""
        if f"{name}=" not in self.columns:
            self.columns[f"{name}="] = F.concat(F.lit(f"{name}="), F.substring(self.raw(name), 1, 200))
        return self.columns[f"{name}="]

    def found(self, name: str) -> Column:
        """What literals.FOUND says of the field's lower-cased text."""
        return F.col(f"h{self.at[name]}__")

    def holds(self, name: str, texts: list[str], every: bool = False) -> Column:
        """Whether any, or every one, of ``texts`` occurs in the field: asked of its automaton, which project() runs over all that was asked before."""
        group = self.searches.setdefault(name, Literals()).group(texts, every)
        return F.array_contains(self.found(name)["groups"], group)

    def project(self, df: DataFrame, values: dict[str, Column] | None = None) -> DataFrame:
        """Adds both columns of each field, and of searched fields what is found; ``values`` overrides how a field is read."""
        values = dict(values or {})
        if ALL_TEXT in self.at:
            values.setdefault(ALL_TEXT, F.concat_ws("\n", *[c for c in ("description", "raw_data") if c in df.columns]))
        if any(n not in values and n not in TOP_LEVEL for n in self.at):
            df = df.withColumn("raw__", F.try_parse_json("raw_data"))
        df = df.withColumns({f"f{i}__": F.coalesce(values.get(n, field_value(n, F.col("raw__") if "raw__" in df.columns else None)).cast("string"), F.lit("")) for n, i in self.at.items()})
        df = df.withColumns({f"l{i}__": F.lower(F.col(f"f{i}__")) for i in self.at.values()})
        searched = {f"h{self.at[n]}__": one.column(self.low(n)) for n, one in self.searches.items()}
        return df.withColumns(searched) if searched else df


# --- compiler --------------------------------------------------------------------------------------------

def _many(argument) -> list[str]:
    return [str(a) for a in (argument if isinstance(argument, (list, tuple)) else [argument])]


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def operator(op: str, raw: Column, low: Column, argument) -> Column:
    """One field operator. All ignore case but regex; a number that can't be read never compares."""
    lows = [a.lower() for a in _many(argument)]
    if op == "equals":
        return low == lows[0]
    if op == "equals_any":
        return low.isin(lows)
    if op == "contains":
        return low.contains(lows[0])
    if op == "contains_any":
        return any_of([low.contains(a) for a in lows])
    if op == "contains_all":
        return all_of([low.contains(a) for a in lows])
    if op == "startswith_any":
        return any_of([low.startswith(a) for a in lows])
    if op == "endswith_any":
        return any_of([low.endswith(a) for a in lows])
    if op == "regex":
        return raw.rlike(str(argument))
    if op == "exists":
        return (raw != "") == F.lit(bool(argument))
    if op == "is_true":
        return low.isin("true", "1", "yes") == F.lit(bool(argument))
    if op in ("gt", "lt"):
        n = _number(raw)
        return F.coalesce(n > float(argument) if op == "gt" else n < float(argument), F.lit(False))
    raise RuleError(f"no operator {op}")


def compile_condition(condition: dict, fields: Fields) -> tuple[Column, Column]:
    """(predicate, what to say about the match) of one condition; its operators must all hold."""
    if not isinstance(condition, dict) or "field" not in condition:
        raise RuleError(f"condition without a field: {condition}")
    name, ops = str(condition["field"]), {k: v for k, v in condition.items() if k != "field"}
    if not ops:
        raise RuleError(f"condition without an operator: {condition}")
    raw, low = fields.raw(name), fields.low(name)
    tests = [fields.holds(name, _many(a), op == "contains_all") if op in ("contains_any", "contains_all") and len(_many(a)) >= MANY else operator(op, raw, low, a) for op, a in ops.items()]
    return all_of(tests), fields.said(name)


def compile_block(block, fields: Fields, depth: int = 0) -> tuple[Column, Column]:
    """(predicate, explanation) of a block: reasons of all parts, then of the first alternative that holds, joined by `` | ``."""
    if depth > DEEPEST:
        raise RuleError("blocks are nested too deep")
    if isinstance(block, (list, tuple)):
        block = {"all": block}
    if not isinstance(block, dict):
        raise RuleError(f"not a block: {block}")
    if "all" not in block and "any" not in block:
        return compile_condition(block, fields)
    every = [compile_block(b, fields, depth + 1) for b in block.get("all") or []]
    some = [compile_block(b, fields, depth + 1) for b in block.get("any") or []]
    if not every and not some:
        raise RuleError("empty block")
    if not some and len(every) == 1:
        return every[0]
    test = all_of([p for p, _ in every]) if every else None
    reasons = [r for _, r in every]
    if some:
        test = test & any_of([p for p, _ in some]) if every else any_of([p for p, _ in some])
        reasons.append(F.coalesce(*[F.when(p, r) for p, r in some]))
    return test, F.concat_ws(" | ", *reasons)


def compile_rule(rule: Rule, fields: Fields) -> tuple[Column, Column]:
    test, reason = compile_block(rule.match, fields)
    if rule.exclude:
        test = test & ~any_of([compile_block(x, fields)[0] for x in rule.exclude])
    return test, reason


def read_rules(spark, folder: str) -> list[Rule]:
    """The rules of every YAML file below a folder that Spark can read, by path. Rules are program text: they are compiled on the driver."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yml,yaml}").select("_metadata.file_path", "value")
    return load_rules(r["value"] for r in files.orderBy("file_path").toLocalIterator())


def validate(rules: Iterable[Rule]) -> list[str]:
    """Compiles every rule; returns warnings (rules without a technique)."""
    rules = list(rules)
    for r in rules:
        compile_rule(r, Fields(fields_of(r)))
    return [f"{r.id} names no technique" for r in rules if not r.attack]


def in_scope(rule: Rule, artifact_type: Column) -> Column:
    """Scope by prefix, or by equality for exact scopes; no scope is everything."""
    if not rule.types:
        return F.lit(True)
    return artifact_type.isin(*rule.types) if rule.exact else any_of([artifact_type.startswith(t) for t in rule.types])


def _guard(rule: Rule) -> tuple[str, tuple[str, ...]] | None:
    """(field, values) of a guard condition that must hold for the rule to match."""
    block = rule.match
    parts = block if isinstance(block, (list, tuple)) else block.get("all") or ([block] if "field" in block else [])
    for name in GUARDS:
        for c in parts:
            if isinstance(c, dict) and c.get("field") == name and ("equals" in c or "equals_any" in c):
                return name, tuple(sorted(a.lower() for a in _many(c.get("equals", c.get("equals_any")))))
    return None


def _dispatch(guard: Column, values: list[str], groups: dict[str, Column], other: Column) -> Column:
    """The group of the guard's value, else ``other``: values are halved by a comparison at a time, so a row passes log2(values) tests and then its own group's rules."""
    if len(values) == 1:
        return F.when(guard == values[0], groups[values[0]]).otherwise(other)
    half = len(values) // 2
    return F.when(guard < values[half], _dispatch(guard, values[:half], groups, other)).otherwise(_dispatch(guard, values[half:], groups, other))


def matches(df: DataFrame, rules: list[Rule], keep: list[str], values: dict[str, Column] | None = None, type_column: str = "artifact_type") -> DataFrame:
    """One row for each (row, matching rule): ``keep`` columns, rule_id and matched_on.

    A single scan: matching rules are collected in an array a row and exploded.
    """
    fields = Fields(n for r in rules for n in fields_of(r))
    free: list[Column] = []
    guarded: dict[str, dict[str, list[Column]]] = {}
    for r in rules:
        test, reason = compile_rule(r, fields)
        hit = F.when(in_scope(r, F.col(type_column)) & test if r.types else test, F.struct(F.lit(r.id).alias("rule_id"), reason.alias("matched_on")))
        guard = _guard(r)
        if guard is None:
            free.append(hit)
        for value in dict.fromkeys(guard[1]) if guard else ():
            guarded.setdefault(guard[0], {}).setdefault(value, []).append(hit)
    base = fields.project(df, values)
    empty = F.array().cast("array<struct<rule_id:string,matched_on:string>>")
    parts = [F.array_compact(F.array(*free[k : k + CHUNK])) for k in range(0, len(free), CHUNK)]
    parts += [_dispatch(fields.low(name), sorted(by), {v: F.array_compact(F.array(*hits)) for v, hits in by.items()}, empty) for name, by in guarded.items()]
    found = base.select(*keep, F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("hit__")) if parts else base.select(*keep, F.explode(empty).alias("hit__"))
    return found.select(*keep, "hit__.rule_id", "hit__.matched_on")


def rules_frame(spark, rules: list[Rule]) -> DataFrame:
    """The rules' own columns, a small table to join hits with."""
    return spark.createDataFrame([(r.id, r.title, r.severity, int(r.points), list(r.attack)) for r in rules], "rule_id string, rule_title string, severity string, score int, attack array<string>")


def detect(artifacts: DataFrame, rules: list[Rule], engine: str = "rules", host: str | None = None, case_id: str | None = None) -> DataFrame:
    """Detections of all rules over the artifacts, one for each (artifact, rule)."""
    if case_id is not None:
        artifacts = artifacts.where(F.col("case_id") == case_id)
    if host is not None:
        artifacts = artifacts.where(F.col("host") == host)
    scoped = [r for r in rules if r.types]
    if scoped and len(scoped) == len(rules):
        # the union of all scopes goes to the scan, where it prunes partitions
        artifacts = artifacts.where(reduce(lambda a, b: a | b, [in_scope(r, F.col("artifact_type")) for r in rules]))
    found = matches(artifacts, rules, ["artifact_id", "case_id"])
    told = rules_frame(artifacts.sparkSession, rules)  # as many rows as rules
    return found.join(told, "rule_id").select("artifact_id", "case_id", F.lit(engine).alias("engine"), "rule_id", "rule_title", "severity", "score", "attack", "matched_on")


def coverage(rules: list[Rule], types: DataFrame, applies=None) -> DataFrame:
    """rule_id, scope and state of each rule: runnable if evidence has a type in scope, blocked if not, not_applicable where ``applies(rule)`` is false (another platform)."""
    spark = types.sparkSession
    rows = [(r.id, t, r.exact) for r in rules for t in (r.types or ("",))]
    table = spark.createDataFrame(rows, "rule_id string, scope string, exact boolean")
    seen = types.select("artifact_type").distinct()
    met = table.join(seen, F.when(F.col("exact"), F.col("artifact_type") == F.col("scope")).otherwise(F.col("artifact_type").startswith(F.col("scope"))), "left")
    out = met.groupBy("rule_id").agg(F.max(F.col("artifact_type").isNotNull()).alias("seen"), F.array_join(F.array_sort(F.collect_set("scope")), ", ").alias("scope"))
    other = [r.id for r in rules if applies and not applies(r)]
    return out.select("rule_id", "scope", F.when(F.col("rule_id").isin(*other) if other else F.lit(False), "not_applicable").when(F.col("seen"), "runnable").otherwise("blocked").alias("state"))


def unseen_fields(artifacts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, field) pairs that no artifact in the rule's scope has, so the condition can never hold."""
    return unseen_paths(artifacts, [(r.id, f, t, r.exact) for r in rules for f in fields_of(r) if f not in (*TOP_LEVEL, ALL_TEXT) for t in (r.types or ("",))])


def paths_of(schema: str) -> list[str]:
    """The dotted paths of all keys of nested objects in a schema as Spark writes that of a variant; what stands in arrays has none."""
    out: list[str] = []

    def kind(at: int, prefix: tuple[str, ...] | None) -> int:
        """Reads a type; returns the place behind it. ``prefix`` is None within an array."""
        if schema.startswith("OBJECT<", at):
            at += 7
            while schema[at] != ">":
                at = key(at + 2 if schema.startswith(", ", at) else at, prefix)
            return at + 1
        if schema.startswith("ARRAY<", at):
            return kind(at + 6, None) + 1
        depth = 0
        while at < len(schema) and (depth or schema[at] not in ",>"):
            depth += {"(": 1, ")": -1}.get(schema[at], 0)
            at += 1
        return at

    def key(at: int, prefix: tuple[str, ...] | None) -> int:
        if schema[at] == "`":
            end = at + 1
            while schema[end] != "`" or schema.startswith("``", end):
                end += 2 if schema[end] == "`" else 1
            name, at = schema[at + 1 : end].replace("``", "`"), end + 1
        else:
            end = schema.index(":", at)
            name, at = schema[at:end], end
        path = None if prefix is None else (*prefix, name)
        if path is not None:
            out.append(".".join(path))
        return kind(at + 2, path)

    kind(0, ())
    return out


def path_inventory(artifacts: DataFrame) -> DataFrame:
    """(artifact_type, path, rows): how many artifacts of a type have a key, at any depth of their raw data's objects.

    One scan: rows are counted by the schema of their raw data, and the few schemas are then read
    as paths. Raw data that can't be parsed, or isn't an object, has no paths.
    """
    shape = F.schema_of_variant(F.try_parse_json("raw_data"))
    shapes = artifacts.groupBy("artifact_type", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n")).where(F.col("shape").startswith("OBJECT<"))

    def read(parts):
        import pandas as pd

        for pdf in parts:
            rows = [(t, p, n) for t, shape, n in zip(pdf["artifact_type"], pdf["shape"], pdf["n"], strict=True) for p in set(paths_of(shape))]
            yield pd.DataFrame(rows, columns=["artifact_type", "path", "n"])

    return shapes.mapInPandas(read, "artifact_type string, path string, n long").groupBy("artifact_type", "path").agg(F.sum("n").alias("rows"))


def unseen_paths(artifacts: DataFrame, asked: list[tuple[str, str, str, bool]]) -> DataFrame:
    """unseen_fields() for (rule_id, field, scope, whether the scope is exact) entries."""
    seen = path_inventory(artifacts).select("artifact_type", F.col("path").alias("p"))
    rows = [(i, f, f.removeprefix("raw_data."), t, exact) for i, f, t, exact in asked]
    asked = artifacts.sparkSession.createDataFrame(rows, "rule_id string, field string, path string, scope string, exact boolean")
    fits = F.when(F.col("exact"), F.col("artifact_type") == F.col("scope")).otherwise(F.col("artifact_type").startswith(F.col("scope")))
    met = asked.join(seen, (F.col("p") == F.col("path")) & fits, "left_semi").select("rule_id", "field")
    return asked.select("rule_id", "field").distinct().join(met, ["rule_id", "field"], "left_anti")
