"""Keywords by automaton, address ranges, encodings and timed conditions against plain versions of themselves."""

import ipaddress
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import assert_same
from tracelake import catalog, catalog_sigma
from tracelake.functions import net
from tracelake.plans import rules, sigma
from tracelake.plans.literals import Literals
from tracelake.streaming.near import detect_near

SYSLOG = {"product": "linux", "service": "syslog"}


@pytest.mark.parametrize("name", ["sigma_keyword_corpus", "sigma_aggregations", "sigma_near", "cidr_longest_match", "sigma_spelled_fields", "sigma_refusals", "sigma_technique_index"])
def test_query_equals_its_sql(spark, tiny, name):
    assert_same(catalog.QUERIES[name](spark, tiny), catalog.ORACLE[name], tiny)


# --- literals ------------------------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.text("abA", max_size=3), min_size=1, max_size=4), st.booleans()), min_size=1, max_size=6), st.text("abc", max_size=20))
def test_groups_hold_as_contains_says(groups, text):
    one = Literals()
    numbers = [one.group(texts, every) for texts, every in groups]
    holds, found = one.searcher()(text)
    for n, (texts, every) in zip(numbers, groups, strict=True):
        assert (n in holds) == (all if every else any)(t.lower() in text for t in texts)
    names = {i: t for t, i in one.numbers.items()}
    assert [names[i] for i in found] == [names[i] for i in sorted(i for i, t in names.items() if t in text)]


def _keyword(i, selection, condition="keywords", **more):
    return {"title": f"k{i}", "id": f"k{i}", "logsource": SYSLOG, "detection": {"keywords": selection, **more, "condition": condition}}


def test_keywords_search_all_text_by_case_wildcard_and_scope(spark):
    docs = [_keyword(1, ["Failed Password", "never"]), _keyword(2, {"|all": ["root", "FAILED"]}), _keyword(3, ["fail*from"]), _keyword(4, "plain"), _keyword(5, ["root"], "keywords and not other", other={"who": "bob"}), _keyword(6, [r"5\*5"])]
    rows = [("a", "journal", "Failed password for ROOT", None), ("b", "journal", None, '{"who": "bob", "m": "root was here, fail from x"}'), ("c", "shell_history", "failed password root", None), ("d", "auth_log", "5*5 = 25 plain", "{}"), ("e", "journal", None, None)]
    df = spark.createDataFrame(rows, "artifact_id string, artifact_type string, description string, raw_data string").withColumn("case_id", F.lit("c"))
    found, refused = sigma.assemble(docs)
    assert not refused and [r.group is not None for r in found] == [True, True, False, True, False, True]
    got = sorted((r.artifact_id, r.rule_title, r.matched_on) for r in sigma.detect(df, found).collect())
    assert [(a, t) for a, t, _ in got] == [("a", "k1"), ("a", "k2"), ("a", "k5"), ("b", "k3"), ("d", "k4"), ("d", "k6")]
    assert got[0][2] == "failed password" and got[1][2] == "failed | root"
    # one document alone, by its predicate
    assert [r.artifact_id for r in sigma.matching(df, sigma.compile_sigma(docs[0], {})).orderBy("artifact_id").collect()] == ["a", "c"]


def test_long_lists_of_rules_and_fields_go_to_the_automaton(spark):
    words = [f"word{i}x" for i in range(60)]
    rule = rules.rule_from({"id": "L", "title": "l", "match": [{"field": "description", "contains_any": words}, {"field": "description", "contains_all": ["WORD7X"]}]})
    rows = [("a", "t", "a Word7X b", None), ("b", "t", "word9x", None), ("c", "t", "word", None)]
    df = spark.createDataFrame(rows, "artifact_id string, artifact_type string, description string, raw_data string").withColumn("case_id", F.lit("c"))
    assert [r.artifact_id for r in rules.matches(df, [rule], ["artifact_id"]).collect()] == ["a"]
    doc = {"title": "f", "id": "f", "detection": {"s": {"m|contains": words}, "t": {"m|contains|all": [*words[:29], "word3"]}, "condition": "1 of them"}}
    one = sigma.compile_sigma(doc, {"m": "description"})
    assert one.fields.searches and sorted(r.artifact_id for r in sigma.matching(df, one).collect()) == ["a", "b"]


# --- ranges ----------------------------------------------------------------------------------------------------

def as_struct(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    sign = lambda n: n - (1 << 64) if n >> 63 else n
    return (4, 0, int(a)) if a.version == 4 else (6, sign(int(a) >> 64), sign(int(a) & ((1 << 64) - 1)))


ADDRESSES = ["1.2.3.4", "0.0.0.0", "255.255.255.255", "256.1.1.1", "1.2.3", "01.2.3.4", "::", "::1", "fe80::1", "2001:db8:0:0:1::", "2001:DB8::FFFF", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "1:2:3:4:5:6:7::8", "::ffff:1.2.3.4", "::ffff:1.2.3.400", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::8000:0:0:1", "12345::", "g::", ":1::2", "1:::2", "", ":", "x", None, "10.9.255.1", "fd12:3456::1"]


def test_addresses_are_those_of_the_standard_library(spark):
    rng = random.Random(2)
    texts = ADDRESSES + [str(ipaddress.IPv6Address(rng.getrandbits(128) & ~(((1 << rng.randrange(1, 100)) - 1) << rng.randrange(28)))) for _ in range(150)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", net.address(F.col("t")).alias("a")).collect():
        assert (tuple(r.a) if r.a else None) == (as_struct(r.t) if r.t is not None else None), r.t


def test_ranges_hold_what_the_standard_library_says(spark):
    rng = random.Random(4)
    v4 = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(60)]
    v6 = [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(60)]
    nets = [f"{a}/{n}" for a, n in zip(v4, [0, 1, 8, 31, 32, 24, *range(2, 30)], strict=False)] + [f"{a}/{n}" for a, n in zip(v6, [0, 1, 63, 64, 65, 127, 128, *range(2, 120, 7)], strict=False)]
    df = spark.createDataFrame([(t,) for t in [*v4, *v6, *ADDRESSES]], "t string")
    parsed = [ipaddress.ip_network(n, strict=False) for n in nets]

    def inside(t, some):
        try:
            return any(ipaddress.ip_address(t) in n for n in some)
        except ValueError:
            return False

    own = [n for n in nets if not n.endswith("/0")]
    got = {r.t: r.x for r in df.select("t", net.in_ranges(F.col("t"), own).alias("x")).collect()}
    assert got == {t: t is not None and inside(t, [ipaddress.ip_network(n, strict=False) for n in own]) for t in got}
    table = net.range_table(spark.createDataFrame([(n,) for n in [*nets, "bad", "1.2.3.4/33", None]], "cidr string"))
    best = {r.t: (r.cidr, r.prefix_length) for r in net.longest_match(df.distinct(), "t", table, ["cidr"]).collect()}
    for t in {*v4, *v6}:
        held = [(n.prefixlen, s) for n, s in zip(parsed, nets, strict=True) if inside(t, [n])]
        most = max(k for k, _ in held) if held else None
        assert best.get(t) == ((min(s for k, s in held if k == most), most) if held else None)
    assert net.longest_match(df.limit(0), "t", table, ["cidr"]).count() == 0


# --- time frames -------------------------------------------------------------------------------------------------

TIMED = [
    {"title": "count", "id": "c", "logsource": SYSLOG, "detection": {"s": {"kind": "a"}, "timeframe": "10s", "condition": "s | count() by who > 3"}},
    {"title": "distinct", "id": "d", "logsource": SYSLOG, "detection": {"s": {"kind": ["a", "b"]}, "timeframe": "7s", "condition": "s | count(v) by who, kind >= 3"}},
    {"title": "sum", "id": "s", "logsource": SYSLOG, "detection": {"s": {"kind": "b"}, "timeframe": "5s", "condition": "s | sum(v) > 20"}},
    {"title": "few", "id": "f", "logsource": SYSLOG, "detection": {"s": {"kind": "c"}, "timeframe": "1m", "condition": "s | count() by who == 1"}},
    {"title": "near", "id": "n", "logsource": SYSLOG, "detection": {"s": {"kind": "a"}, "x": {"kind": "b", "v|gt": 5}, "y": {"kind": "c"}, "timeframe": "3s", "condition": "s | near x and not y"}},
    {"title": "self", "id": "m", "logsource": SYSLOG, "detection": {"s": {"kind": "c"}, "x": {"v": ["1", "2"]}, "timeframe": "2s", "condition": "s | near x"}},
]


def timed_rows(n, seconds, seed=1, hot=0.0):
    rng = random.Random(seed)
    return [(str(i), "c1" if rng.random() < 0.8 else None, "h0" if rng.random() < hot else f"h{rng.randrange(3)}", rng.randrange(seconds * 4) / 4, rng.choice("aabbc"), f"u{rng.randrange(3)}", rng.choice(["", "x"]) if rng.random() < 0.1 else str(rng.randrange(9))) for i in range(n)]


def timed_frame(spark, rows):
    df = spark.createDataFrame(rows, "artifact_id string, case_id string, host string, at double, kind string, who string, v string")
    stamp = F.date_format(F.timestamp_micros((F.col("at") * 1_000_000).cast("long") + 1_700_000_000_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return df.select("artifact_id", "case_id", "host", F.lit("journal").alias("artifact_type"), F.lit("").alias("description"), stamp.alias("timestamp_utc"), F.to_json(F.struct("kind", "who", "v")).alias("raw_data"))


def number(v):
    try:
        return float(v)
    except ValueError:
        return None


def plain_timed(rows):
    out = set()
    for i, case, host, at, kind, who, v in rows:
        def window(span, test, case=case, at=at):
            return [r for r in rows if r[1] == case and at - span < r[3] <= at and test(r)]

        def around(span, test, case=case, host=host, at=at):
            return any(r[1] == case and r[2] == host and abs(r[3] - at) <= span and test(r) for r in rows)

        if kind == "a" and len(window(10, lambda r, who=who: r[4] == "a" and r[5] == who)) > 3:
            out.add((i, "count"))
        if kind in "ab" and len({r[6] for r in window(7, lambda r, who=who, kind=kind: r[4] == kind and r[5] == who) if r[6] != ""}) >= 3:
            out.add((i, "distinct"))
        if kind == "b" and sum(number(r[6]) or 0 for r in window(5, lambda r: r[4] == "b")) > 20:
            out.add((i, "sum"))
        if kind == "c" and len(window(60, lambda r, who=who: r[4] == "c" and r[5] == who)) == 1:
            out.add((i, "few"))
        if kind == "a" and around(3, lambda r: r[4] == "b" and (number(r[6]) or 0) > 5) and not around(3, lambda r: r[4] == "c"):
            out.add((i, "near"))
        if kind == "c" and around(2, lambda r: r[6] in ("1", "2")):
            out.add((i, "self"))
    return sorted(out)


@pytest.mark.parametrize(("n", "seconds", "hot"), [(400, 400, 0.0), (500, 60, 0.9), (60, 2, 0.5), (0, 5, 0.0)])
def test_timed_conditions_equal_plain_windows(spark, n, seconds, hot):
    """Sparse and crowded time, ties, a hot host, null cases, values that are empty or no number."""
    rows = timed_rows(n, seconds, hot=hot)
    found, refused = sigma.assemble(TIMED)
    assert not refused
    extra = [("none", "c1", "h0", "journal", "", None, '{"kind": "a", "who": "u0", "v": "1"}'), ("bad", "c1", "h0", "journal", "", "no time", '{"kind": "a"}'), ("other", "c1", "h0", "process", "", "2023-11-14T22:13:20.000000Z", '{"kind": "a"}')]
    df = timed_frame(spark, rows)
    df = df.unionByName(spark.createDataFrame(extra, df.schema))
    assert sorted((r.artifact_id, r.rule_title) for r in sigma.detect(df, found).collect()) == plain_timed(rows)


def test_near_on_a_stream_equals_the_batch(spark, tmp_path):
    rows = timed_rows(300, 200, seed=8)
    found = [r for r in sigma.assemble(TIMED)[0] if r.timed.near]
    whole = timed_frame(spark, rows)
    want = sorted((r.artifact_id, r.rule_id) for r in sigma.detect(whole, found).collect())
    assert len(want) > 20
    # a file every fifty seconds, then one far later event a host, by which the watermark passes all
    parts = [[r for r in rows if r[3] // 50 == k] for k in range(4)] + [[(f"end{h}", "c1", f"h{h}", 9000.0, "a", "u0", "0") for h in range(3)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            timed_frame(spark, part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = detect_near(stream, found, "60 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.artifact_id, r.rule_id) for r in got.where(~F.col("artifact_id").startswith("end")).collect()) == want


# --- spellings ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("key", ["v|base64offset|contains", "v|wide|base64offset|contains", "v|utf16be|base64offset|contains"])
def test_base64_at_every_offset(spark, key):
    import base64

    kind = {"v|wide": "utf-16-le", "v|utf16b": "utf-16-be"}.get(key[:6] if "wide" in key else key[:8], "utf-8")
    step = 2 if kind != "utf-8" else 1
    told = [(str(k), base64.b64encode(b"z" * (k * step) + "Secret Word".encode(kind) + b"?" * j).decode()) for k in range(4) for j in range(3)] + [("no", base64.b64encode(b"nothing here").decode())]
    df = spark.createDataFrame(told, "artifact_id string, v string")
    one = sigma.compile_sigma({"title": "b", "detection": {"s": {key: "Secret Word"}, "condition": "s"}}, {"v": "v"}, fields=rules.Fields(["v"]))
    assert one.fields.project(df, {"v": F.col("v")}).where(one.predicate).count() == 12


def test_cased_field_references_and_placeholders(spark):
    df = spark.createDataFrame([("a", "Bob", "bob"), ("b", "bob", "bob"), ("c", "admin7", ""), ("d", "xbob", "bob")], "artifact_id string, u string, w string")

    def took(selection, **more):
        fields = rules.Fields(["u", "w"])
        one = sigma.compile_sigma({"title": "x", "detection": {"s": selection, "condition": "s"}}, {"u": "u", "w": "w"}, fields=fields, **more)
        return sorted(r.artifact_id for r in fields.project(df, {"u": F.col("u"), "w": F.col("w")}).where(one.predicate).collect())

    assert took({"u|cased": "bob"}) == ["b"] and took({"u": "bob"}) == ["a", "b"]
    assert took({"u|fieldref": "w"}) == ["a", "b"] and took({"u|endswith|fieldref": "w"}) == ["a", "b", "d"]
    assert took({"u|expand": "%who%7"}, placeholders={"who": ["x", "admin"]}) == ["c"]


def test_dispatch_by_value_finds_what_each_rule_finds(spark):
    which = [rules.rule_from({"id": f"r{i}", "title": "t", "match": [{"field": "raw_data.EventId", "equals_any": [i, i, i + 1]}, {"field": "description", "contains": str(i % 3)}]}) for i in range(9)]
    which.append(rules.rule_from({"id": "free", "title": "t", "match": [{"field": "description", "contains": "1"}]}))
    rows = [(str(n), "t", f"d{n}", f'{{"EventId": {n % 12}}}') for n in range(60)] + [("x", "t", "d1", None)]
    df = spark.createDataFrame(rows, "artifact_id string, artifact_type string, description string, raw_data string")
    want = sorted((n, r.id) for n, _, d, raw in rows for i, r in enumerate(which) if (str(i % 3) in d and raw and int(n) % 12 in (i, i + 1) if r.id != "free" else "1" in d))
    assert sorted((r.artifact_id, r.rule_id) for r in rules.matches(df, which, ["artifact_id"]).collect()) == want
    assert catalog_sigma.guarded_rules(3)[2].id == "G2"
