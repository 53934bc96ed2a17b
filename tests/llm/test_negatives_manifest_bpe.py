"""Hard negatives, the Merkle manifest and BPE coding against plain versions of themselves and the library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.helpers import assert_same
from tests.llm.samples import odd_documents
from tracelake.llm import bpe, merkle, negatives
from tracelake.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_merkle_manifest"])
def test_query_equals_its_sql(spark, tiny, name):
    assert_same(QUERIES[name](spark, tiny), ORACLE[name], tiny)


# --- hard negatives ---------------------------------------------------------------------------------------

def plain_mine(rows, is_anchor, k=5, m=10, low=30, high=90):
    out = []
    for a, la, va in rows:
        if not is_anchor(a):
            continue
        told = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, label, v in rows if i != a and len(v) == len(va))
        for s, p, _ in [t for t in told if t[2] == la][:k]:
            fits = [t for t in told if t[2] != la and low * -s <= 100 * -t[0] <= high * -s][:m]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_are_those_of_all_pairs_with_ties_and_hot_labels(spark):
    rng = random.Random(5)
    # small components: many equal scores, zero and negative ones; label 0 holds half of the rows
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 3]), [rng.randrange(-2, 3) for _ in range(4)]) for i in range(-40, 260)] + [(i, i % 2, [1, 2]) for i in range(300, 330)] + [(i, i % 2, [0, 0, 0]) for i in range(400, 440)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<long>")
    want = plain_mine(rows, lambda i: i % 6 == 0)
    assert any(r[4] == 0 for r in want) and len(want) > 500
    assert mined(negatives.mine(df, F.col("vec_id") % 6 == 0)) == want
    assert mined(negatives.mine(df, F.col("vec_id") % 6 == 0, anchor_block=7, row_block=23)) == want
    assert mined(negatives.mine(df, F.col("vec_id") % 6 == 0, 2, 3, 10, 99, row_block=50)) == plain_mine(rows, lambda i: i % 6 == 0, 2, 3, 10, 99)


def test_negatives_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0], "x"), (1, 1, [1.0, 1.0], "x"), (2, 2, [0.5, 0.5], "x"), (3, 2, None, "x"), (4, None, [1.0, 1.0], "x"), (5, 2, [nan, 1.0], "x"), (6, 2, [inf, 1.0], "x"), (7, 2, [None, 1.0], "x"), (2, 2, [0.5, 0.5], "x"), (None, 2, [1.0, 1.0], "x"), (8, 2, [], "x"), (9, 1, [], "x"), (10, 3, [1e300, 1.0], "x"), (11, 1, [1e12, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, `score.x` string").withColumn("embedding", negatives.quantised(F.col("embedding")))
    got = mined(negatives.mine(df, F.col("vec_id") == 0))
    assert [r[:4] for r in got] == [(0, 1, 1, 2), (0, 11, 1, 10)] or [r[:4] for r in got] == [(0, 1, 1, 2)]
    assert got[0][4:] == (256 * 256 * 3, 256 * 128 * 3)
    assert mined(negatives.mine(df.limit(0), F.col("vec_id") == 0)) == []
    assert mined(negatives.mine(df.where("vec_id = 0"), F.col("vec_id") == 0)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(negatives.LEAST, negatives.MOST), st.integers(0, 1), st.integers(-9, 9)), max_size=30))
def test_packed_keys_sort_as_wanted(keys):
    packed = [negatives.pack(*k) for k in keys]
    assert [negatives.unpack(p) for p in packed] == keys
    assert [negatives.unpack(p) for p in sorted(packed)] == sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3]))


def test_scores_are_exact_at_any_size():
    for size in (10, 1 << 26, 1 << 40):
        x = np.array([[size, -3, size - 1], [1, 2, 3]], np.int64)
        y = np.array([[size, 5, 7], [-size, size, -size]], np.int64)
        want = [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in y] for p in x]
        assert negatives.scores(x, y).tolist() == [[min(max(v, negatives.LEAST), negatives.MOST) for v in row] for row in want]


# --- Merkle manifest ---------------------------------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(leaves):
    """(root, siblings with sides of each leaf), level by level."""
    level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            q = p ^ 1
            paths[i].append((p % 2, level[q] if q < len(level) else None))
            at[i] = p // 2
        level = [H(*level[j : j + 2]) for j in range(0, len(level), 2)]
    return level[0], paths


def plain_check(rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[lang] = plain_tree([plain_leaf(*r) for r in by[lang]])
    root, upper = plain_tree([trees[lang][0] for lang in langs])
    out = []
    for lang, up in zip(langs, upper, strict=True):
        for r, path in zip(by[lang], trees[lang][1], strict=True):
            steps, shown = path + up, list(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                shown[3] += 1
            h = plain_leaf(*shown)
            for side, s in steps:
                h = H(h) if s is None else H(s, h) if side else H(h, s)
            out.append((str(r[0]), plain_leaf(*r), trees[lang][0], root, H(*[s for _, s in steps if s]), h, h == root))
    return sorted(out)


def checked(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.mark.parametrize("sizes, bits", [((1,), 2), ((1, 1), 1), ((5, 1, 13, 4), 2), ((64, 33, 7), 2), ((100,), 10), ((9, 8, 17), 1)])
def test_manifest_equals_plain_trees(spark, sizes, bits):
    rows = [(1000 * k + 3 * i, f"s{i % 3}", ["de", None, "é", "zz"][k], None if i % 5 == 4 else i, f"text {i} é") for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert checked(merkle.tampered_check(df.repartition(3), bits=bits)) == plain_check(rows)


def test_manifest_of_odd_rows(spark):
    df = odd_documents(spark)
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = checked(merkle.tampered_check(df.withColumns({"hash": F.lit(1), "group": F.lit("g"), "a.b": F.lit(1)}), bits=1))
    assert got == plain_check(rows)
    assert {g[6] for g in got} == {True, False}
    assert checked(merkle.tampered_check(df.limit(0))) == []


def test_one_language_of_equal_rows(spark):
    """Equal rows, all in one language, are leaves of their own, dealt over partitions."""
    rows = [(7, "s", "en", 3, "abc")] * 500
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    assert checked(merkle.tampered_check(df, bits=3)) == plain_check(rows)


def test_a_witness_proves_its_row_only(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    told = merkle.manifest(docs, bits=4).collect()
    assert all(merkle.fold(r.leaf, r.witness) == r.root for r in told)
    assert not any(merkle.fold(a.leaf, b.witness) == b.root for a, b in zip(told, told[1:], strict=False) if a.leaf != b.leaf)


# --- BPE ------------------------------------------------------------------------------------------------------

LETTERS = "aabcdefghijklmnopqrstuvwxyzéüßñÀΣςÇ’'!?.,#-–…0123456789 \n\t<|>日🎉́"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def same_as_library(library, texts):
    code = bpe.coder()
    for text, raw in zip(texts, code.encode_bytes(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(raw, "<u4").tolist()
        assert got == want, text[:100]
        assert code.decode(got) == library.decode(want, skip_special_tokens=False)


def test_words_of_every_length(library):
    rng = random.Random(3)
    words = ["".join(rng.choice("aaabcdeéilnorst") for _ in range(n)) for n in [*range(1, 140), 500, 3000, 20000] for _ in range(3)]
    same_as_library(library, [*words, *("a" * n for n in range(1, 150)), "", " \n\t ", "<|endoftext|>", "x<|startoftext|>y", "don't WE'LL it's 1234 ÉCOLE", "é Å"])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=120))
def test_any_text(library, text):
    same_as_library(library, [text])


def test_scanning_and_heap_take_the_same_merges():
    rng = random.Random(9)
    code = bpe.coder()
    words = [bytes(rng.choice(b"aabbcdeorst\xc3\xa9") for _ in range(rng.randrange(1, bpe.SHORT + 1))) for _ in range(800)]
    for width in bpe.WIDTHS:
        fit = [w for w in words if len(w) <= width]
        assert code._scan(fit, width) == [code._heap(w) for w in fit]


def test_digests_of_odd_rows(spark, library):
    df = odd_documents(spark)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df).collect())
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), len(ids), H(" ".join(map(str, ids))), H(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.digests(df.limit(0)).collect() == []



def test_coding_hands_on_columns_of_any_name(spark, library):
    df = odd_documents(spark).withColumnRenamed("w", "a.b").withColumnRenamed("s", "ids").withColumnRenamed("n", "decoded")
    coded = bpe.encode(df)
    assert coded.columns == [*df.columns, "ids_"]
    told = bpe.decode(coded, "ids_")
    assert told.columns == [*df.columns, "ids_", "decoded_"]
    for r in told.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids_"] == ids and r["decoded_"] == library.decode(ids, skip_special_tokens=False) and r["a.b"] == "w"


def test_bpe_query_equals_library_on_the_table(spark, tiny, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in QUERIES["op13_bpe_round_trip"](spark, tiny).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), H(" ".join(map(str, ids))), H(library.decode(ids, skip_special_tokens=False)))
