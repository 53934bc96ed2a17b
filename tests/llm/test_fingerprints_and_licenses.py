import hashlib
import math
import random
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tests.helpers import assert_same
from tests.llm.samples import DOCS, odd_documents
from tracelake.llm import fingerprint, licenses, queries


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(rows):
        other, k = rows[(i + 1) % len(rows)][1] or "", len(text or "") // 3
        out[doc] = hashlib.sha256(((text or "")[: len(text or "") - k] + other[:k]).encode()).hexdigest()
    return out


@pytest.mark.parametrize("per_range", [1000, 20])
def test_edits_and_likeness(spark, tiny, per_range):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = fingerprint.edited_pairs(docs, per_range).toPandas()
    want = brute_edits(docs.select("doc_id", "text").collect())
    assert len(got) == docs.count() and all(want[i] == h for i, h in zip(got.doc_id, got.edited_sha256, strict=True))
    assert (got.near_edited > got.near_next).mean() > 0.9 and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    text = dict(docs.select("doc_id", "text").collect())
    by = {}
    for i, f in zip(got.doc_id, got.fingerprint, strict=True):
        assert by.setdefault(text[i], f) == f


def spark_hash(values, seed=42):
    """Spark's xxhash64 of longs, one after the other, or of a text."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def brute_terms(text):
    return list(dict.fromkeys(spark_hash([t]) for t in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if t))


def brute_band(texts, bits=20):
    """The buckets that at least 2 and at most 5 % of the documents hold."""
    n = Counter(b for t in texts for b in {h & ((1 << bits) - 1) for h in brute_terms(t)})
    return {b for b, c in n.items() if 2 <= c <= max(2, len(texts) // 20)}


def brute_codes(text, band, bits=20):
    """(level, dense, sparse, whole) from plain sets: each of the 64 subsets keeps the terms whose cell it is, the last one all."""
    every = brute_terms(text)
    kept = [h for h in every if h & ((1 << bits) - 1) in band]
    kept = kept if len(kept) >= 4 else every
    level = 6 + max(0, math.ceil(math.log2(max(len(kept), 1) / 32)))
    cell = lambda h, up: ((h & ((1 << 64) - 1)) >> bits) & ((1 << (level + up)) - 1)
    whole = f"{spark_hash(sorted(kept)) & ((1 << 64) - 1):016x}" if kept else "----"
    kept = sorted(h for h in kept if cell(h, 0) < 64)

    def codes(up):
        subsets = [[h for h in kept if cell(h, up) == s] for s in range(64)]
        return [f"{spark_hash(t) & 0xFFFF:04x}" if t else "----" for t in subsets]

    return level, codes(0), codes(1), whole


def brute_string(codes, text):
    if codes[3] == "----":
        return f"text:{spark_hash([text]) & ((1 << 64) - 1):X}"
    return f"{codes[0]:02d}:{codes[3]}:{''.join(codes[1])}:{''.join(codes[2])}"


def brute_likeness(a, b, string_a, string_b):
    if string_a == string_b:
        return 1.0
    if abs(a[0] - b[0]) > 1:
        return 0.0
    pairs = zip([*a[1 if a[0] >= b[0] else 2], a[3]], [*b[1 if b[0] >= a[0] else 2], b[3]], strict=True)
    pairs = [(x, y) for x, y in pairs if (x, y) != ("----", "----")]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


@pytest.mark.parametrize("table", ["driver", "odd"])
def test_fingerprints_and_likeness_by_brute_force(spark, tiny, table):
    """Every column of the operator against sets, sorted lists and the hash library, from the whole table's frequencies."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet") if table == "driver" else odd_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = docs.select("doc_id", "text").cache()
    rows = sorted(((r[0], r[1] or "") for r in docs.collect()), key=lambda r: -r[0])
    band = brute_band([t for _, t in rows])
    want = {}
    for i, (doc, text) in enumerate(rows):
        after, k = rows[(i + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        own, alt, nxt = (brute_codes(t, band) for t in (text, edited, after))
        names = [brute_string(c, t) for c, t in ((own, text), (alt, edited), (nxt, after))]
        want[doc] = (len(text), names[0], names[1], brute_likeness(own, alt, names[0], names[1]), brute_likeness(own, nxt, names[0], names[2]))
    got = {r["doc_id"]: (r["n_chars"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in fingerprint.edited_pairs(docs).collect()}
    assert len(got) == len(rows) and {k for k in want if got[k] != want[k]} == set()


def test_fingerprints_of_odd_rows(spark):
    got = fingerprint.edited_pairs(odd_documents(spark)).toPandas()
    assert len(got) == len(DOCS)
    by = {r.doc_id: r for r in got.itertuples() if r.doc_id == r.doc_id}
    assert by[1].fingerprint == by[2].fingerprint and by[3].fingerprint == by[4].fingerprint and by[3].n_chars == 0
    assert fingerprint.edited_pairs(odd_documents(spark).where("false")).count() == 0
    one = fingerprint.edited_pairs(odd_documents(spark).where("doc_id = 7")).first()
    assert one["near_next"] == 1.0


def test_long_texts_with_a_few_words_replaced_differ(spark):
    """90 of 9,000 words replaced: other fingerprints and a likeness below 1, for every pair."""
    rng = random.Random(5)
    rows = []
    for pair in range(6):
        words = [f"w{rng.randrange(40_000)}" for _ in range(9000)]
        other = list(words)
        for at in rng.sample(range(9000), 90):
            other[at] = f"w{rng.randrange(40_000)}"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    rows += [(100 + i, f"filler text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(docs).where("doc_id < 12").collect()}
    for pair in range(6):
        # the next document of an odd id is its pair's other text
        first, second = got[2 * pair], got[2 * pair + 1]
        assert first["fingerprint"] != second["fingerprint"] and 0.5 < second["near_next"] < 1


def test_no_python_in_the_plan(spark, tiny):
    for df in (fingerprint.edited_pairs(spark.read.parquet(f"{tiny}/documents.parquet")), licenses.scan(spark.read.parquet(f"{tiny}/documents.parquet"))):
        assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()


def test_license_scan_equals_its_sql(spark):
    from tests.conftest import DATA

    assert_same(queries.op6_license_scan(spark, f"{DATA}/sf0.01"), queries.ORACLE["op6_license_scan"], f"{DATA}/sf0.01")


def test_licenses_in_odd_rows(spark):
    notice = licenses.TEMPLATES[6][1]
    words = notice.split()
    edited = " ".join(words[:20] + ["oops"] + words[21:])
    far = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, far + " " + notice.upper()), (2, far + " " + edited + " " + far), (3, None), (4, ""), (5, "released under the mit license"), (6, " ".join(words[:10])), (1, far + " " + notice.upper())]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"license": F.lit("x"), "s": F.lit(1), "at": F.lit(1)})).toPandas()
    found = sorted(zip(got.doc_id, got.license, got.containment == 1.0, strict=True))
    assert found == [(1, "GPL-3.0-or-later", True), (2, "GPL-3.0-or-later", False), (5, "MIT", True)]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), []).count() == 0
