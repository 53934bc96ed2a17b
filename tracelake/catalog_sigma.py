"""Queries of content rules and of Sigma documents with keywords, encodings, ranges and time frames, and their SQL twins.

Where a query needs many documents or ranges, it makes them from rows of the driver's tables, so they
grow with the tables. Documents are program text and are compiled on the driver.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import net
from tracelake.plans import rules, sigma, stored
from tracelake.registry import register, table
from tracelake.sources import yara

SYSLOG = {"product": "linux", "service": "syslog"}


# --- keywords ---------------------------------------------------------------------------------------------

def keyword_documents(rows) -> list[dict]:
    """Two documents for each (item_id, text): any run of three words of the text; its first and its last such run."""
    out = []
    for item, text in rows:
        words = (text or "").lower().split()
        runs = list(dict.fromkeys(" ".join(words[i : i + 3]) for i in range(len(words) - 2)))
        if runs:
            out.append({"title": f"any of {item}", "id": f"any-{item}", "logsource": SYSLOG, "detection": {"keywords": runs, "condition": "keywords"}})
            out.append({"title": f"ends of {item}", "id": f"ends-{item}", "logsource": SYSLOG, "detection": {"keywords": {"|all": [runs[0], runs[-1]]}, "condition": "keywords"}})
    return out


def _texts(spark, d):
    """Documents as journal lines."""
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"), F.lit("case-a").alias("case_id"), F.lit("journal").alias("artifact_type"), F.col("text").alias("description"), F.lit(None).cast("string").alias("raw_data"))


@register("sigma_keyword_corpus", r"""WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
runs AS (SELECT item_id, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS r FROM w WHERE len(w) > 2),
phrases AS (SELECT item_id, unnest(list_distinct(r)) AS p FROM runs),
known AS (SELECT DISTINCT p FROM phrases),
found AS (SELECT doc_id, p FROM documents, known WHERE contains(lower(text), p)),
hits AS (SELECT doc_id, item_id, p FROM found JOIN phrases USING (p))
SELECT CAST(doc_id AS VARCHAR) AS artifact_id, 'any of ' || item_id AS rule_title, string_agg(p, ' | ' ORDER BY p) AS matched_on FROM hits GROUP BY doc_id, item_id
UNION ALL SELECT CAST(h.doc_id AS VARCHAR), 'ends of ' || h.item_id, string_agg(DISTINCT p, ' | ' ORDER BY p) FROM hits h JOIN runs r ON r.item_id = h.item_id AND h.p IN (r.r[1], r.r[-1])
GROUP BY h.doc_id, h.item_id, r.r HAVING count(DISTINCT p) = CASE WHEN r.r[1] = r.r[-1] THEN 1 ELSE 2 END""")
def sigma_keyword_corpus(spark, d):
    """Keyword documents made from every benchmark passage, all of them searched for in one pass over each text."""
    rows = ((r["item_id"], r["text"]) for r in table(spark, d, "benchmark").toLocalIterator())
    found, _ = sigma.assemble(keyword_documents(rows))
    return sigma.detect(_texts(spark, d), found).select("artifact_id", "rule_title", "matched_on")


# --- time frames --------------------------------------------------------------------------------------------

def _lines(spark, d):
    """Events as journal lines of a host."""
    e = table(spark, d, "events")
    raw = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"), F.col("value"), F.get_json_object("props", "$.k").alias("k")))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return e.select(F.col("event_id").cast("string").alias("artifact_id"), F.lit("case-a").alias("case_id"), F.concat(F.lit("host-"), (F.col("user_id") % 7).cast("string")).alias("host"), F.lit("journal").alias("artifact_type"), F.lit("").alias("description"), stamp.alias("timestamp_utc"), raw.alias("raw_data"))


COUNTED = """
title: many errors
id: t-1
logsource: {product: linux, service: syslog}
detection: {sel: {kind: error}, timeframe: 2d, condition: sel | count() by user > 2}
---
title: many users
id: t-2
logsource: {product: linux, service: syslog}
detection: {sel: {kind: [purchase, view]}, low: {k|lt: 5}, timeframe: 6h, condition: sel and not low | count(user) by kind > 28}
---
title: much value
id: t-3
logsource: {product: linux, service: syslog}
detection: {sel: {kind: purchase}, timeframe: 1w, condition: sel | sum(value) by user >= 350}
---
title: low mean
id: t-4
logsource: {product: linux, service: syslog}
detection: {sel: {kind: [click, signup]}, timeframe: 12h, condition: sel | avg(value) by user < 10.5}
"""
_FRAME = "(PARTITION BY {by} ORDER BY ts RANGE BETWEEN INTERVAL '{most} microseconds' PRECEDING AND CURRENT ROW)"


def _frame(by: str, hours: int) -> str:
    return _FRAME.format(by=by, most=hours * 3_600_000_000 - 1)


@register("sigma_aggregations", f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE ts IS NOT NULL),
a AS (SELECT event_id, 'many errors' AS rule_title, CAST(count(*) OVER {_frame('user_id', 48)} AS DOUBLE) AS v, v > 2 AS holds FROM e WHERE event_type = 'error'),
b AS (SELECT event_id, 'many users', CAST(count(DISTINCT user_id) OVER {_frame('event_type', 6)} AS DOUBLE) AS v, v > 28 FROM e WHERE event_type IN ('purchase', 'view') AND NOT coalesce(k < 5, false)),
c AS (SELECT event_id, 'much value', CAST(sum(CAST(value AS DECIMAL(24, 6))) OVER {_frame('user_id', 168)} AS DOUBLE) AS v, v >= 350 FROM e WHERE event_type = 'purchase'),
m AS (SELECT event_id, 'low mean', sum(CAST(value AS DECIMAL(24, 6))) OVER {_frame('user_id', 12)} / count(*) OVER {_frame('user_id', 12)} AS v, v < 10.5 FROM e WHERE event_type IN ('click', 'signup'))
SELECT CAST(event_id AS VARCHAR) AS artifact_id, rule_title FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM m) WHERE holds""")
def sigma_aggregations(spark, d):
    """Counts, distinct counts, sums and means of sliding time frames, from YAML, in one sweep."""
    import yaml

    found, _ = sigma.assemble(list(yaml.safe_load_all(COUNTED)))
    return sigma.detect(_lines(spark, d), found).select("artifact_id", "rule_title")


NEAR = """
title: purchase near an error, without a signup
id: n-1
logsource: {product: linux, service: syslog}
detection: {bought: {kind: purchase}, wrong: {kind: error}, joined: {kind: signup}, timeframe: 45m, condition: bought | near wrong and not joined}
---
title: two kinds near a view
id: n-2
logsource: {product: linux, service: syslog}
detection: {seen: {kind: view}, a: {kind: click, k|gt: 30}, b: {kind: [error, purchase]}, timeframe: 1h, condition: seen | near a and b}
"""


@register("sigma_near", """WITH e AS (SELECT event_id, event_type AS kind, user_id % 7 AS host, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT CAST(event_id AS VARCHAR) AS artifact_id, 'purchase near an error, without a signup' AS rule_title FROM e WHERE kind = 'purchase'
AND EXISTS (SELECT 1 FROM e o WHERE o.host = e.host AND o.kind = 'error' AND o.ts BETWEEN e.ts - INTERVAL 45 MINUTE AND e.ts + INTERVAL 45 MINUTE)
AND NOT EXISTS (SELECT 1 FROM e o WHERE o.host = e.host AND o.kind = 'signup' AND o.ts BETWEEN e.ts - INTERVAL 45 MINUTE AND e.ts + INTERVAL 45 MINUTE)
UNION ALL SELECT CAST(event_id AS VARCHAR), 'two kinds near a view' FROM e WHERE kind = 'view'
AND EXISTS (SELECT 1 FROM e o WHERE o.host = e.host AND o.kind = 'click' AND o.k > 30 AND o.ts BETWEEN e.ts - INTERVAL 1 HOUR AND e.ts + INTERVAL 1 HOUR)
AND EXISTS (SELECT 1 FROM e o WHERE o.host = e.host AND o.kind IN ('error', 'purchase') AND o.ts BETWEEN e.ts - INTERVAL 1 HOUR AND e.ts + INTERVAL 1 HOUR)""")
def sigma_near(spark, d):
    """Events that stand near others of their host, and not near some, within a time frame."""
    import yaml

    found, _ = sigma.assemble(list(yaml.safe_load_all(NEAR)))
    return sigma.detect(_lines(spark, d), found).select("artifact_id", "rule_title")


# --- ranges -----------------------------------------------------------------------------------------------------

@register("cidr_longest_match", r"""WITH found AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:\d{1,3}\.){3}\d{1,3}')) AS a FROM documents),
sure AS (SELECT doc_id, a, list_transform(string_split(a, '.'), lambda x: CAST(x AS INT)) AS o FROM found WHERE NOT regexp_matches(a, '(^|\.)0\d')),
addr AS (SELECT doc_id, a, ((o[1] * 256::BIGINT + o[2]) * 256 + o[3]) * 256 + o[4] AS n FROM sure WHERE list_max(o) < 256),
nets AS (SELECT c_custkey AS id, 3 + c_custkey % 22 AS len, (c_custkey * 2654435761) % 4294967296 AS n FROM customer),
ranges AS (SELECT id, len, (n // CAST(2 ** (32 - len) AS BIGINT)) AS p FROM nets)
SELECT doc_id, a AS address, CAST(min(id) AS BIGINT) AS net, CAST(r.len AS INT) AS prefix_length FROM addr JOIN ranges r ON addr.n // CAST(2 ** (32 - r.len) AS BIGINT) = r.p
GROUP BY doc_id, a, r.len QUALIFY row_number() OVER (PARTITION BY doc_id, a ORDER BY r.len DESC) = 1""")
def cidr_longest_match(spark, d):
    """The longest of a range for every customer that holds each address in the documents."""
    n = F.pmod(F.col("c_custkey") * F.lit(2654435761), F.lit(4294967296))
    octet = lambda k: F.shiftright(n, 8 * k).bitwiseAND(255).cast("string")
    nets = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("net"), F.concat(octet(3), F.lit("."), octet(2), F.lit("."), octet(1), F.lit("."), octet(0), F.lit("/"), (3 + F.col("c_custkey") % 22).cast("string")).alias("cidr"))
    found = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:\d{1,3}\.){3}\d{1,3}"), F.lit(0)))).alias("address"))
    return net.longest_match(found, "address", net.range_table(nets), ["net"]).select("doc_id", "address", "net", "prefix_length")


# --- spellings, fields and ranges within a document ------------------------------------------------------------

SPELLED = """
title: hidden word
id: e-1
logsource: {product: linux, service: auditd}
detection: {s: {blob|base64offset|contains: URGENT}, condition: s}
---
title: hidden wide word
id: e-2
logsource: {product: linux, service: auditd}
detection: {s: {wide|wide|base64offset|contains: MEDIUM}, condition: s}
---
title: same number twice
id: e-3
logsource: {product: linux, service: auditd}
detection: {s: {customer|endswith|fieldref: digit}, not_s: {digit: ['0']}, condition: s and not not_s}
---
title: one of the watched
id: e-4
logsource: {product: linux, service: auditd}
detection: {s: {name|expand: 'u%watched%'}, condition: s}
---
title: from a range
id: e-5
logsource: {product: linux, service: auditd}
detection: {s: {address|cidr: [10.0.0.0/14, '10.9.0.0/16', 'fd00::/8']}, condition: s}
"""


@register("sigma_spelled_fields", """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS artifact_id, * FROM orders)
SELECT artifact_id, 'hidden word' AS rule_title FROM o WHERE contains(o_orderpriority, 'URGENT')
UNION ALL SELECT artifact_id, 'hidden wide word' FROM o WHERE contains(o_orderpriority, 'MEDIUM')
UNION ALL SELECT artifact_id, 'same number twice' FROM o WHERE o_custkey % 10 = o_orderkey % 10 AND o_orderkey % 10 <> 0
UNION ALL SELECT artifact_id, 'one of the watched' FROM o WHERE o_custkey % 50 IN (3, 17, 44)
UNION ALL SELECT artifact_id, 'from a range' FROM o WHERE o_custkey % 16 IN (0, 1, 2, 3, 9)""")
def sigma_spelled_fields(spark, d):
    """Encoded values, field references, placeholders and ranges over every order."""
    import yaml

    hidden = F.concat(F.repeat(F.lit("x"), (F.col("o_orderkey") % 3).cast("int")), "o_orderpriority", F.lit("--"))
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    address = F.concat(F.lit("10."), (customer % 16).cast("string"), F.lit("."), (key % 256).cast("string"), F.lit(".7"))
    raw = F.to_json(F.struct(F.base64(F.encode(hidden, "UTF-8")).alias("blob"), F.base64(F.encode(hidden, "UTF-16LE")).alias("wide"), customer.cast("string").alias("customer"), (key % 10).cast("string").alias("digit"), F.concat(F.lit("u"), (customer % 50).cast("string")).alias("name"), address.alias("address")))
    logs = table(spark, d, "orders").select(key.cast("string").alias("artifact_id"), F.lit("case-a").alias("case_id"), F.lit("auditd").alias("artifact_type"), raw.alias("raw_data"))
    found, _ = sigma.assemble(list(yaml.safe_load_all(SPELLED)), placeholders={"watched": ["3", "17", "44"]})
    return sigma.detect(logs, found).select("artifact_id", "rule_title")


# --- what documents are refused for, and what they name ---------------------------------------------------------

def supplier_documents(rows) -> list[tuple[str, dict]]:
    """A document for each supplier key: by its remainders its log source, its condition and its technique vary."""
    out = []
    for key in rows:
        source = {"product": "mars", "category": "rover"} if key % 5 == 0 else SYSLOG
        condition = "sel and" if key % 7 == 0 else "sel | min(k) > 3" if key % 11 == 0 else "other" if key % 13 == 0 else "sel"
        own = {"sel": {"k": key}, "timeframe": "1h", "condition": condition} if "|" in condition else {"sel": {"k": key}, "condition": condition}
        more = {"filter_x": {"k": 1}} if key % 3 == 0 else {}
        out.append((f"s{key}", {"title": f"s{key}", "id": f"s{key}", "logsource": source, "tags": [f"attack.t10{key % 20:02d}", "attack.execution"], "detection": {**own, **more}}))
    return out


def _suppliers(spark, d):
    return (r[0] for r in table(spark, d, "supplier").select(F.col("s_suppkey").cast("long")).orderBy("s_suppkey").toLocalIterator())


@register("sigma_refusals", """WITH r AS (SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'log source mars/rover isn''t collected' WHEN s_suppkey % 7 = 0 THEN 'condition ends early' WHEN s_suppkey % 11 = 0 THEN 'aggregation by min'
WHEN s_suppkey % 13 = 0 THEN 'unknown selection other' END AS reason FROM supplier) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 15""")
def sigma_refusals(spark, d):
    """Why documents, one for each supplier, are refused: a top-k report."""
    return sigma.refusal_counts(spark, sigma.assemble([doc for _, doc in supplier_documents(_suppliers(spark, d))])[1])


@register("sigma_technique_index", """SELECT 'T10' || lpad(CAST(s_suppkey % 20 AS VARCHAR), 2, '0') AS technique, count(*) AS rules, count(*) FILTER (s_suppkey % 3 = 0) AS with_filter, string_agg('s' || s_suppkey, ',' ORDER BY 's' || s_suppkey) AS titles FROM supplier GROUP BY 1""")
def sigma_technique_index(spark, d):
    """The techniques that documents, one for each supplier, name."""
    return sigma.technique_index(spark, supplier_documents(_suppliers(spark, d))).withColumn("titles", F.array_join("titles", ","))


# --- dispatch by value ----------------------------------------------------------------------------------------------

def guarded_rules(n: int) -> list[rules.Rule]:
    """``n`` rules, each for one event id, that differ in what else they ask."""
    return [rules.rule_from({"id": f"G{i}", "title": f"guarded {i}", "match": [{"field": "raw_data.EventId", "equals": i}, {"field": "description", "endswith_any": [str(i % 10), str((i + 3) % 10)]}]}) for i in range(n)]


@register("rule_dispatch_by_value", """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS artifact_id, 10 * CAST(json_extract_string(props, '$.k') AS INT) + user_id % 10 AS id, 'user ' || CAST(user_id // 10 AS VARCHAR) AS description, user_id // 10 AS tens FROM events)
SELECT artifact_id, 'G' || id AS rule_id, 'raw_data.EventId=' || id || ' | description=' || description AS matched_on FROM e WHERE id < 1000 AND tens % 10 IN (id % 10, (id + 3) % 10)""")
def rule_dispatch_by_value(spark, d):
    """A thousand rules over events, of which a row tries those of its event id."""
    e = table(spark, d, "events")
    number = 10 * F.get_json_object("props", "$.k").cast("int") + F.col("user_id") % 10
    rows = e.select(F.col("event_id").cast("string").alias("artifact_id"), F.lit("event_log").alias("artifact_type"), F.concat(F.lit("user "), F.floor(F.col("user_id") / 10).cast("string")).alias("description"), F.to_json(F.struct(number.cast("string").alias("EventId"))).alias("raw_data"))
    return rules.matches(rows, guarded_rules(1000), ["artifact_id"])


# --- file content --------------------------------------------------------------------------------------------------

def passage_rules(rows) -> str:
    """A YARA rule for each (item_id, text): its first and last three words in any case, and none of its middle ones."""
    out = []
    for item, text in rows:
        words = "".join(c if c.isalnum() and c.isascii() else " " for c in text or "").split()
        if len(words) > 8:
            middle = len(words) // 2
            first, last, other = (" ".join(words[i : i + 3]) for i in (0, len(words) - 3, middle - 1))
            out.append(f'rule P{item} {{ meta: severity = "medium" strings: $a = "{first}" nocase $b = "{last}" nocase $c = "{other}" condition: any of ($a, $b) and not $c }}')
    return "\n".join(out)


@register("yara_documents", r"""WITH w AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(text, '[^0-9A-Za-z]', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT item_id, array_to_string(w[1:3], ' ') AS a, array_to_string(w[-3:], ' ') AS b, array_to_string(w[len(w) // 2 : len(w) // 2 + 2], ' ') AS c FROM w WHERE len(w) > 8),
hits AS (SELECT doc_id, item_id, contains(lower(text), lower(a)) AS x, contains(lower(text), lower(b)) AS y FROM documents, p WHERE NOT contains(text, c))
SELECT doc_id, 'P' || item_id AS rule, CASE WHEN x AND y THEN '$a, $b' WHEN x THEN '$a' ELSE '$b' END AS matched_on FROM hits WHERE x OR y""")
def yara_documents(spark, d):
    """Content rules made from every benchmark passage over whole texts."""
    text = passage_rules((r["item_id"], r["text"]) for r in table(spark, d, "benchmark").toLocalIterator())
    return yara.scan_rows(table(spark, d, "documents"), "text", ["doc_id"], text).select("doc_id", "rule", "matched_on")


# --- Sigma as stored rules ------------------------------------------------------------------------------------------

BRANCHED = """
title: negated alternatives
id: b-1
level: high
logsource: {product: linux, service: syslog}
detection: {a: {kind: error}, b: {k|lt: 30}, c: {user|endswith: ['1', '2']}, condition: (a or b) and not (c and b)}
---
title: most of them
id: b-2
level: low
logsource: {product: linux, service: syslog}
detection: {s1: {kind|contains: [c, w]}, s2: {k|gt: 60}, s3: {user: '1?'}, filter: {value: null}, condition: 2 of s* and not filter}
"""


@register("sigma_stored_rules", r"""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS artifact_id, event_type AS kind, CAST(user_id AS VARCHAR) AS u, CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events),
t AS (SELECT *, kind = 'error' AS a, coalesce(k < 30, false) AS b, u LIKE '%1' OR u LIKE '%2' AS c, contains(kind, 'c') OR contains(kind, 'w') AS s1, coalesce(k > 60, false) AS s2, regexp_full_match(u, '1.') AS s3 FROM e)
SELECT artifact_id, 'negated alternatives' AS rule_title FROM t WHERE (a OR b) AND NOT (c AND b)
UNION ALL SELECT artifact_id, 'most of them' FROM t WHERE s1::INT + s2::INT + s3::INT >= 2 AND value IS NOT NULL""")
def sigma_stored_rules(spark, d):
    """Sigma documents as rules of our own language: alternatives with exclusions, over every event."""
    import yaml

    written, _ = stored.translate([("b.yml", doc) for doc in yaml.safe_load_all(BRANCHED)])
    which = [rules.rule_from(r) for r in written]
    return rules.detect(_lines(spark, d), which).select("artifact_id", "rule_title").distinct()


# --- what raw data holds ------------------------------------------------------------------------------------------------

@register("json_path_inventory", """WITH o AS (SELECT 'type-' || (o_custkey % 2) AS artifact_type, o_orderkey AS k FROM orders),
p AS (SELECT artifact_type, 'a' AS path FROM o WHERE k % 5 <> 0 UNION ALL SELECT artifact_type, 'a.b' FROM o WHERE k % 5 <> 0 AND k % 2 = 0 UNION ALL SELECT artifact_type, 'a.c' FROM o WHERE k % 5 <> 0 AND k % 3 = 0
UNION ALL SELECT artifact_type, 'a.c.d' FROM o WHERE k % 5 <> 0 AND k % 3 = 0 UNION ALL SELECT artifact_type, 'a.c.d.e' FROM o WHERE k % 5 <> 0 AND k % 3 = 0 UNION ALL SELECT artifact_type, 'a.c.d.e.odd key' FROM o WHERE k % 5 <> 0 AND k % 3 = 0 AND k % 7 = 0
UNION ALL SELECT artifact_type, 'list' FROM o) SELECT artifact_type, path, count(*) AS "rows" FROM p GROUP BY ALL""")
def json_path_inventory(spark, d):
    """Every path in nested raw data made of orders, five objects deep, with the number of rows that have it."""
    k = F.col("o_orderkey")
    deep = F.struct(F.struct(F.struct(F.when(k % 7 == 0, "x").alias("odd key")).alias("e")).alias("d"))
    a = F.struct(F.when(k % 2 == 0, k).alias("b"), F.when(k % 3 == 0, deep).alias("c"))
    raw = F.to_json(F.struct(F.when(k % 5 != 0, a).alias("a"), F.array(F.struct(k.alias("inside"))).alias("list")))
    return rules.path_inventory(table(spark, d, "orders").select(F.concat(F.lit("type-"), (F.col("o_custkey") % 2).cast("string")).alias("artifact_type"), raw.alias("raw_data")))
