import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import assert_same
from tests.llm.samples import DOCS, odd_documents
from tracelake.llm import ann, chat, jaccard, queries, stages
from tracelake.llm.textbytes import shingle_sets


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets, head = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                head[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(first.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def ours(df, **bounds):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(df, **bounds).collect())


def test_join_equals_brute_force_on_the_tiny_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert ours(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_chains_of_near_copies_and_a_shared_passage(spark, monkeypatch):
    """Copies that drift apart are one component; documents that only share a passage aren't."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 9999, 120)]
    rows, doc = [], 0
    for _ in range(60):
        words[rng.integers(0, 120)] = f"x{doc}"
        rows.append((doc, " ".join(words)))
        doc += 1
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(40):
        rows.append((doc, passage + " " + " ".join(f"q{doc}_{i}" for i in range(int(rng.integers(10, 40))))))
        doc += 1
    for edits in range(1, 12):  # around the border of 75 %
        base = [f"b{edits}_{i}" for i in range(80)]
        rows.append((doc, " ".join(base)))
        for e in range(edits):
            base[e * 7] = f"e{edits}_{e}"
        rows.append((doc + 1, " ".join(base)))
        doc += 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ours(df) == brute(rows)
    # the same where no group and no cluster fits a task
    monkeypatch.setattr(jaccard, "HOT_ENTRIES", 4)
    assert ours(df, group_rows=3, block_tokens=400) == brute(rows)


def test_join_of_odd_rows(spark):
    df = odd_documents(spark)
    assert ours(df) == brute([(d, t) for d, t, _, _ in DOCS])
    assert ours(df.where("false")) == []
    kept = stages.dedup_stage(spark, df, "")
    assert kept.columns == df.columns
    ids = sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect())
    assert ids == sorted(map(str, [1, 3, 4, 5, 7, 9, 11, None]))
    assert stages.dedup_stage(spark, df.where("false"), "").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("aAbB \t\n\x0b\x1cé ")), max_size=40)), max_size=6))
def test_shingle_sets_have_the_right_sizes_and_equalities(texts):
    import pyarrow as pa

    from tracelake.llm.textbytes import flat

    got = shingle_sets(*flat(pa.array(texts, pa.string())))
    want = [shingles(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=60), min_size=2, max_size=25))
def test_signature_trees_lose_no_link(sets):
    """Checked or not, the tree joins all that links join; with the exact check it joins nothing else."""
    arrays = [np.unique(np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    sizes, maps = np.array([len(s) for s in sets]), [jaccard.bitmap(a) for a in arrays]
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    loose, exact, want = np.arange(len(sets)), np.arange(len(sets)), np.arange(len(sets))
    jaccard.search(sizes, maps, loose)
    forest = jaccard.search(sizes, maps, exact, linked)
    for i in range(len(sets)):
        for j in range(i):
            if linked(i, j):
                want[want == want[j]] = want[i]
                assert loose[i] == loose[j]
    assert all(linked(i, j) for i, j in forest) and len(forest) < len(sets)
    assert len(forest) == len(sets) - len(np.unique(want))
    assert all((exact == exact[i]).tolist() == (want == want[i]).tolist() for i in range(len(sets)))


def test_components_of_a_long_chain(spark):
    order = np.random.default_rng(1).permutation(300)
    links = [(int(order[i]), int(order[i + 1])) for i in range(299)] + [(1000, 1001)]
    got = dict(jaccard.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert set(got) == {*range(300), 1000, 1001} and {got[i] for i in range(300)} == {0} and got[1001] == 1000


def test_components_spread_a_hub(spark):
    """Hubs beyond the limit, a chain and pairs beside them: the same components as without a limit."""
    links = [(7, x) for x in range(100, 160)] + [(500, x) for x in range(120, 180)] + [(x, x + 1) for x in range(1000, 1006)] + [(5000, 5000), (1006, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    want = dict(jaccard.components(frame).collect())
    assert {want[x] for x in (100, 179, 500, 1000, 7)} == {7} and 5000 not in want
    assert dict(jaccard.components(frame, hot=10).collect()) == want
    rows = frame.select(F.col("a").alias("k"), F.col("b").alias("v"))
    every = sorted((a, b, min(y for x, y in links if x == a)) for a, b in links)
    for hot in (5, 10**6):
        assert sorted(tuple(r) for r in jaccard.with_least(rows, "k", F.col("v"), "m", len(links), hot).select("k", "v", "m").collect()) == every


def test_spanning_links_are_links_of_every_component(spark):
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(words[:i] + [f"x{i}"] + words[i + 1 :]) for i in range(0, 60, 12)} | {100: " ".join(words), 101: " ".join(words), 102: "one two", 103: "", 104: "ONE two"}
    docs = spark.createDataFrame([*texts.items(), (None, "one two"), (105, None)], "doc_id long, text string")
    found = jaccard.spanning_links(docs).collect()
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in texts.items()}
    assert all(100 * len(sets[r["a"]] & sets[r["b"]]) >= 75 * len(sets[r["a"]] | sets[r["b"]]) and (r["n_a"], r["n_b"]) == (len(sets[r["a"]]), len(sets[r["b"]])) for r in found)
    roots = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect() if r["doc_id"] is not None}
    parent = {i: i for i in roots}
    for r in found:
        x, y = sorted((parent[r["a"]], parent[r["b"]]))
        parent = {k: x if v == y else v for k, v in parent.items()}
    assert {k for k in texts if roots[k] == 0} == {0, 12, 24, 36, 48, 100, 101} and roots[104] == 102 and len({parent[k] for k in (0, 12, 24, 36, 48, 100)}) == 1 and len(found) == 5


def test_prefix_entries_are_short():
    """Whole tokens travel by their low bytes and compress below 15 bytes an entry; divided ones keep all bytes."""
    rng = np.random.default_rng(2)
    token, name = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2), rng.integers(-(1 << 63), 1 << 63, 20_000)
    n, block = np.sort(rng.integers(20, 400, 20_000)).astype(np.uint32), np.zeros(20_000, np.uint32)
    raw = jaccard.packed(token, name, n, block)
    assert len(pa.compress(raw, "lz4_raw", asbytes=True)) < 15 * 20_000
    low = np.uint64((1 << 8 * jaccard.TOKEN_BYTES) - 1)
    got = jaccard.unpacked(raw)
    assert all(np.array_equal(a, b) for a, b in zip(got, ((token & low).view(np.int64), name, n, block), strict=True))
    block[7:9] = 3
    got = jaccard.unpacked(jaccard.packed(token, name, n, block))
    assert np.array_equal(got[0][7:9].view(np.uint64), token[7:9]) and np.array_equal(got[0][9:].view(np.uint64), token[9:] & low) and np.array_equal(got[3], block)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=40), min_size=2, max_size=12), st.integers(2, 64))
def test_holders_left_out_lose_no_link(sets, few):
    """Linked sets stay together in the group of the first token that they share; places told two to a byte come back."""
    arrays = [np.unique(np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    size = np.array([len(a) for a in arrays])
    many = jaccard.prefix_length(size)
    token = np.concatenate([a[:k] for a, k in zip(arrays, many, strict=True)])
    name, n = np.repeat(np.arange(len(sets)), many), np.repeat(size, many)
    where = jaccard.place(np.concatenate([np.arange(k) for k in many]), n)
    assert np.array_equal(jaccard._whole(jaccard._halves(where), len(where)), where)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jaccard, "FEW_HOLDERS", few)
        got = jaccard.holders(token, name, n, np.zeros(len(n), np.uint32), 1000, jaccard.reach(where, n))
    together = {(a, b) for g in got for a in g[3].tolist() for b in g[3].tolist()}
    distinct = {frozenset(s): i for i, s in enumerate(sets)}.values()
    for i in distinct:
        for j in distinct:
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and i != j:
                assert (i, j) in together


def test_holders_by_chance_are_left_out():
    """Two sets of one size whose first common token is late in both prefixes can't be linked, and no bitmap of theirs is sent."""
    n = np.array([100, 100, 100, 100])
    token, name = np.array([5, 5, 6, 6], np.uint64), np.array([1, 2, 1, 3])
    where = jaccard.place(np.array([20, 25, 3, 4]), n)
    got = jaccard.holders(token, name, n, np.zeros(4, np.uint32), 1000, jaccard.reach(where, n))
    assert [g[3].tolist() for g in got] == [[1, 3]]


# --- search -------------------------------------------------------------------------------------------------------------

def test_recall_and_exact_scores(spark, tiny):
    v = spark.read.parquet(f"{tiny}/embeddings.parquet")
    got = ann.search(v, F.col("vec_id") % 20 == 0, block=200, query_block=7).toPandas()
    pdf = v.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    hit = n = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and mine.score.is_monotonic_decreasing
        assert np.allclose(mine.score, [s[np.flatnonzero(ids == i)[0]] for i in mine.vec_id], atol=1e-12)
        hit, n = hit + len(set(mine.vec_id) & set(ids[best])), n + 20
    assert hit / n >= 0.9


def hard_rows(kind):
    """1,500 rows on which codes tell few rows apart."""
    rng = np.random.default_rng(5)
    if kind == "near copies":  # more of each than are scored first
        return rng.normal(size=(3, 32))[rng.integers(0, 3, 1500)] + 1e-3 * rng.normal(size=(1500, 32))
    if kind == "common offset":
        return 50 + 0.1 * rng.normal(size=(1500, 32))
    if kind == "lengths":
        return rng.normal(size=(1500, 32)) * np.exp(4 * rng.normal(size=(1500, 1)))
    return 1e25 * rng.normal(size=(1500, 32))


@pytest.mark.parametrize("kind", ["near copies", "common offset", "lengths", "large components"])
def test_all_of_the_nearest_are_found(spark, kind):
    """On rows that share codes too; over one block and several."""
    x = hard_rows(kind).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    y, ids = x.astype(float), np.arange(1500)
    for block, query_block in ((65_536, 2048), (600, 40)):
        got = ann.search(v, F.col("vec_id") % 20 == 0, block=block, query_block=query_block).toPandas()
        for q in range(0, 1500, 20):
            s = np.cumsum(y * y[q], 1)[:, -1]
            s[q] = -np.inf
            best = np.lexsort((ids, -s))[:20]
            mine = got[got.query_id == q].sort_values("rank")
            assert mine.vec_id.tolist() == best.tolist() and mine.score.tolist() == s[best].tolist()


def test_search_of_odd_rows(spark):
    e = [1.0, 2.0, 0.5]
    rows = [(0, e), (1, e), (2, e), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 1.0]), (6, [float("nan"), 1.0, 1.0]), (7, [-1.0, 0.0, 0.0]), (1, e), (None, e)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit("x")})
    got = [tuple(r) for r in ann.search(v, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 5.25), (0, 2, 2, 5.25), (0, 3, 7, -1.0)]
    assert ann.search(v.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("width", [1, 7, 384])
def test_equal_vectors_rank_by_id(spark, width):
    """37 equal vectors and some others: equal scores, smaller ids first, at any width and over several blocks."""
    rng = np.random.default_rng(width)
    same = rng.normal(size=width).tolist()
    rows = [(i, same) for i in range(38)] + [(100 + i, (-1 * np.abs(rng.normal(size=width)) * np.sign(same)).tolist()) for i in range(30)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(v, F.col("vec_id") % 20 == 0, block=16, query_block=2).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21)) and len({r["score"] for r in got}) == 1


def test_codes_weigh_the_parallel_error():
    x = np.random.default_rng(0).normal(size=(2000, 16))
    book = ann.fit_codebook(x)
    codes = book.encode(x)
    back = book.centers[np.arange(8), codes].reshape(2000, 16)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    plain = ann.Codebook(book.centers, 1.0)
    flat = book.centers[np.arange(8), plain.encode(x)].reshape(2000, 16)
    assert np.abs(((x - back) * unit).sum(1)).mean() <= np.abs(((x - flat) * unit).sum(1)).mean() + 1e-9
    assert np.allclose(ann.scan(book, codes, x[:5]), x[:5] @ back.T, atol=1e-4)


# --- chat ----------------------------------------------------------------------------------------------------------------

def render(template, **env):
    return "".join(t for t, _ in chat.compile_template(template)(env))


def test_template_language():
    assert render("{% for m in xs %}{% if m.a == 1 and not m.b %}A{% elif m['a'] in ys %}B{% else %}C{% endif %}{{ m.a ~ '-' | upper }}{% endfor %}", xs=[{"a": 1}, {"a": 2}, {"a": 3}], ys=[2]) == "A1-B2-C3-"
    assert render("{# no #}{% set x = 'a' + 'b' %}{{ x | length }}{{ y }}") == "2"
    marked = list(chat.compile_template("x{% generation %}{{ t }}{% endgeneration %}y")({"t": "T"}))
    assert marked == [("x", False), ("T", True), ("y", False)]


def test_constants_are_folded():
    tree = chat.fold(chat.parse("{% if 1 == 1 %}a{{ 'b' ~ 'c' | upper }}{% else %}d{% endif %}{% if false %}{{ x }}{% endif %}{{ y }}"))
    assert tree == ("block", [("out", ("const", "abC")), ("out", ("name", "y"))])


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a | nope }}", "{{ a. }}", "{{ f(1) }}", "{% endif %}", "{{ 'a }}", "{% import os %}"])
def test_templates_outside_the_language(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_sandbox():
    assert render("{{ x.__class__ }}{{ x['y'] }}", x="s") == ""


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(list("<|%25C3im_end>A0\n a")), max_size=30))
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_digests_equal_their_sql(spark, tiny):
    assert_same(queries.op10_chat_format(spark, tiny), queries.ORACLE["op10_chat_format"], tiny)


def test_odd_conversations_round_trip(spark):
    rows = [(1, 0, "user", queries.INJECTED), (1, 1, "assistant", queries.INJECTED), (2, 0, None, None), (2, 0, None, None), (None, 3, "assistant", "x\n<|im_start|>%25"), (3, None, "a\nb", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.chat_digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    x = queries.INJECTED
    assert got[1]["turns_sha256"] == sha(f"user\n{x}\nassistant\n{x}\n") and got[1]["loss_sha256"] == sha(x) and got[1]["loss_chars"] == len(x)
    assert got[2]["n_turns"] == 2 and got[2]["turns_sha256"] == sha("\n\n\n\n") and got[2]["loss_chars"] == 0
    assert got[None]["loss_sha256"] == sha("x\n<|im_start|>%25") and got[3]["turns_sha256"] == sha("a\nb\nt\n")
    whole = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    span = whole[1]["loss_spans"][0]
    assert chat.unescape(whole[1]["formatted"][span["start"] : span["end"]]) == x and len(whole[1]["formatted"]) == got[1]["formatted_chars"]
    assert chat.chat_digests(df.where("false")).count() == 0


def test_conversation_ids_beside_nulls_are_exact(spark):
    df = spark.createDataFrame([(2**53 + 1, 0, "user", "a"), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string").coalesce(1)
    assert {r["conv_id"] for r in chat.chat_digests(df).collect()} == {2**53 + 1, None} == {r["conv_id"] for r in chat.format_chats(df).collect()}


def test_dedup_of_null_and_repeated_ids(spark):
    """Rows are told apart by id and text: near copies without an id go, and of two texts with one id only the head stays."""
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:-1], f"z{k}"])
    rows = [(1, near(1), 0), (None, near(2), 0), (None, "something else that stands quite alone here", 0), (5, near(3), 0), (5, "another lonely text with more than five words", 0), (1, near(1), 1), (1, near(1), 1), (None, None, 0), (None, "", 0), (7, " ", 0), (7, " ", 0)]
    kept = stages.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, x int").repartition(3), "")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect())
    assert got == sorted((str(d), str(t)) for d, t in [(1, near(1)), (None, rows[2][1]), (5, rows[4][1]), (None, None), (None, ""), (7, " "), (7, " ")])
