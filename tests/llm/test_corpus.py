import collections
import hashlib
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aislelens.llm import html_text, licenses, mixing, near_dedup, packing, queries, repeats, store, tokens, topk, toxicity, vector_dedup
from aislelens.llm.common import join_salted, new_folder
from aislelens.llm.components import connected_components

BASE = " ".join(f"word{k}" for k in range(60))
#: Nulls, empty and short texts, ties, repeated rows, a long text, near copies.
ROWS = [
    (1, BASE, "a"), (2, BASE + " more", "a"), (3, None, None), (4, "", "b"), (5, "one two", "b"), (6, "ONE two", "b"), (7, BASE, "c"), (7, BASE, "c"),
    (None, BASE, "a"), (8, "x" * 250 + " " + "lorem ipsum dolor " * 2000, "a"), (9, "Ünïcödé " * 40 + BASE[:150], None),
]
DOCS = "doc_id long, text string, source string, row_no string, size string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_near_dedup(docs, none):
    got = [tuple(r) for r in near_dedup.near_duplicates(docs).collect()]
    by = collections.defaultdict(list)
    for i, n, c, k in got:
        by[i].append((n, c, k))
    assert by[1] == [(56, 1, True)] and by[2] == [(57, 1, False)] and by[7] == [(56, 1, False)] * 2
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[6] == [(1, 5, False)] and by[None] == [(56, None, True)] and len(got) == len(ROWS)
    assert near_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("limits", [{}, {"star": (2, 1 << 20), "chunk": (2, 1 << 20)}, {"star": (2048, 100), "chunk": (512, 100)}])
def test_near_dedup_brute(spark, limits):
    rng, vocab = np.random.default_rng(1), [f"w{k}" for k in range(40)]
    texts = [list(rng.choice(vocab, 80)) for _ in range(6)]
    for k in range(60):
        t = list(texts[rng.integers(len(texts))])
        t[rng.integers(len(t))] = f"n{k}"
        texts.append(t)
    sets = [set(zip(*(t[i:] for i in range(5)), strict=False)) for t in texts]
    up = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 85 * len(a | b):
                    up[i] = min(up[i], up[j])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, **limits).collect()} == dict(enumerate(up))


def test_sketch_fills_every_coordinate():
    assert (near_dedup.sketches([np.array([5], np.uint64), np.arange(3, dtype=np.uint64)]) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def brute_repeats(rows, least=100):
    seen, out = set(), []
    for _, t in rows:
        hit = bytearray(len(t))
        for a in range(len(t) - least + 1):
            if t[a : a + least] in seen:
                hit[a : a + least] = b"\1" * least
            seen.add(t[a : a + least])
        out.append((len(t), sum(hit), hashlib.sha256(bytes(x for x, h in zip(t, hit, strict=True) if not h)).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{"most": 1}, {"most": 2}, {"part": 300}])
def test_repeats_in_small_parts(spark, limits):
    rng = np.random.default_rng(5)
    gram = " " * 32
    rows = [(k, gram.join("".join(rng.choice(list("ab"), 60 if k % 3 else 7)) for _ in range(6)) + gram) for k in range(60)]
    rows += [(100 + k, rows[k][1][40:260] + f"tail {k} " * 30) for k in range(0, 20, 3)]
    want = collections.Counter((i, *x) for (i, *_), x in zip(rows, brute_repeats([(i, t.encode()) for i, t in rows]), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in repeats.deduplicate_documents(df, **limits).collect())
    assert got == want


def test_repeats_of_one_passage_in_many_surroundings(spark, monkeypatch):
    """A passage whose anchor has many contexts: its windows are merged and joined in parts, none is sorted with all others."""
    rng = np.random.default_rng(8)
    passage = "".join(rng.choice(list("klmnop"), 130))
    rows = [(k, "".join(rng.choice(list("abcdefgh"), 90)) + passage + "".join(rng.choice(list("abcdefgh"), 90))) for k in range(3000)]
    joined, plain = [], repeats.join_salted
    monkeypatch.setattr(repeats, "join_salted", lambda left, right, keys, *rest: joined.append(keys) or plain(left, right, keys, *rest))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.deduplicate_documents(spark.createDataFrame(rows, "doc_id long, text string"), most=16).collect()}
    assert ["h", "bytes"] in joined and len(got) == 3000
    for (k, text), (n, removed, digest) in zip(rows, brute_repeats([(k, t.encode()) for k, t in rows]), strict=True):
        assert got[k] == (removed, int(removed > 0), digest) and n == len(text)


def test_repeats(docs, none):
    rows = sorted((r for r in ROWS), key=lambda r: (r[0] is not None, r[0]))
    want = collections.Counter((i, *x) for (i, *_), x in zip(rows, brute_repeats([(i, (t or "").encode()) for i, t, _ in rows]), strict=True))
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in repeats.deduplicate_documents(docs).collect())
    assert got == want and repeats.deduplicate_documents(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=24))
def test_maximal_repeats(text):
    t = text.encode()
    want = set()
    for n in range(2, len(t)):
        at = collections.defaultdict(list)
        for i in range(len(t) - n + 1):
            at[t[i : i + n]].append(i)
        for p in at.values():
            if len(p) > 1 and (len({t[i - 1] if i else -1 for i in p}) > 1) and (len({t[i + n] if i + n < len(t) else -1 - i for i in p}) > 1):
                want.add((n, tuple(p)))
    assert {(n, tuple(p)) for n, p in repeats.maximal_repeats(t, 2)} == want


def test_mixing(docs, none):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in ROWS)
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) <= 4 and mixing.mix_documents(none).count() == 0
    assert mixing.curriculum(docs).columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_uses_each_piece_once(count):
    used = collections.Counter()
    for bins, combo in packing.plan(count, 40):
        assert bins > 0 and sum(n * k for n, k in combo.items()) <= 40
        for n, k in combo.items():
            used[n] += bins * k
    assert used == collections.Counter(count)


def test_packing(docs, none):
    path = tokens.vocabulary("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path).toPandas()
    enc = tokens.Encoder(path, True)
    by = {}
    for i, t, _ in ROWS:
        by[i] = np.append(enc.whole(t or ""), 2).astype("<u4")
    for r in got.itertuples():
        ids = by[None if r.doc_id != r.doc_id else int(r.doc_id)][r.start : r.start + r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32
    assert got.length.sum() == sum(len(by[i]) for i, _, _ in ROWS)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 1024
    assert packing.pack_documents(none, path).count() == 0


def test_store(spark, docs, none):
    path, folder = tokens.vocabulary("word_bpe_49k.json"), new_folder(spark, "store")
    store.write_store(docs, path, folder)
    enc, at = tokens.Encoder(path, False), 0
    got = store.stored_documents(spark, folder).orderBy(F.col("doc_id").asc_nulls_first(), "row_no").collect()
    for r, (i, t, _) in zip(got, sorted(ROWS, key=lambda r: (r[0] is not None, r[0])), strict=True):
        ids = np.append(enc.whole(t or ""), 2).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert store.verify(spark, folder) and len(store.root(spark, folder)) == 64
    assert {r["doc_id"]: len(r["ids"]) for r in store.read_documents(spark, folder).collect()}[8] > 1000
    empty = new_folder(spark, "store")
    store.write_store(none, path, empty)
    assert store.stored_documents(spark, empty).count() == 0 and store.verify(spark, empty)


@pytest.mark.parametrize("harm", ["chunk lost", "chunk changed", "document lost", "recipe row lost", "recipe order", "recipe row twice", "none"])
def test_store_tampered(spark, docs, tmp_path, harm):
    path, good, folder = tokens.vocabulary("word_bpe_49k.json"), new_folder(spark, "store"), f"file://{tmp_path}/store"
    store.write_store(docs, path, good)
    chunks, recipes, manifest = (spark.read.parquet(f"{good}/{k}") for k in ("chunks", "recipes", "manifest"))
    key = recipes.where("doc_id = 8").orderBy("at").first()["key"]
    if harm == "chunk lost":
        chunks = chunks.where(F.col("key") != F.lit(key))
    elif harm == "chunk changed":
        chunks = chunks.withColumn("data", F.when(F.col("key") == F.lit(key), F.unhex(F.reverse(F.hex("data")))).otherwise(F.col("data")))
    elif harm == "document lost":
        recipes = recipes.where("doc_id <> 5 or doc_id is null")
    elif harm == "recipe row lost":
        recipes = recipes.where("not (doc_id <=> 8 and at = 0)")
    elif harm == "recipe order":
        last = recipes.where("doc_id = 8").orderBy(F.desc("at")).first()
        recipes = recipes.withColumn("key", F.expr(f"case when doc_id <=> 8 and at = 0 then unhex('{last['key'].hex()}') when doc_id <=> 8 and at = {last['at']} then unhex('{key.hex()}') else key end"))
    elif harm == "recipe row twice":
        recipes = recipes.union(recipes.where("doc_id = 8 and at = 0"))
    for name, df in (("chunks", chunks), ("recipes", recipes), ("manifest", manifest)):
        df.write.parquet(f"{folder}/{name}")
    assert store.verify(spark, folder) == (harm == "none")


@pytest.mark.parametrize("text", ["", " a  b\n c", "it's don't!! 12,5 x", "Hello <|endoftext|> you're. \n", "Hello <|startoftext|> you<|endoftext|>\nx", "ΣΑΣ. Ña, b\t\u00a0x", "a\n\nb.\nC"])
def test_cached_tokens(text):
    import pyarrow as pa

    from tokenizers import Tokenizer

    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = tokens.vocabulary(name)
        plain = Tokenizer.from_file(path)
        for limit in (tokens.KNOWN_BYTES, 0):
            enc = tokens.Encoder(path, spaced, limit)
            ids, n = enc.column(pa.array([text, "other words", None, text]))
            want = [plain.encode(t, add_special_tokens=False).ids for t in (text, "other words", "", text)]
            assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    many = spark.createDataFrame([(k, ("vile scum " if k % 2 else "kind words ") + f"and text {k}") for k in range(200)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(many, labels).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([got[k]["score"] for k in range(101, 200, 2)]) > np.mean([got[k]["score"] for k in range(100, 200, 2)])
    assert toxicity.score_toxicity(docs, labels).count() == len(ROWS) and toxicity.score_toxicity(none, labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(ROWS)


def vectors(spark):
    rng = np.random.default_rng(3)
    v = [(k, rng.normal(size=8).tolist(), k % 2) for k in range(120)]
    v += [(200 + k, (np.array(v[k][1]) * 2 + 1e-3).tolist(), k % 2) for k in range(30)] + [(300, v[0][1], 0), (300, v[0][1], 0)]
    v += [(401, None, 0), (402, [], 0), (403, [float("nan")] * 8, 0), (404, [0.0] * 8, 0), (405, v[0][1], None), (None, v[0][1], 0), (406, [None] * 8, 1)]
    return v, spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")


def test_topk(spark):
    v, df = vectors(spark)
    ok = {i: np.floor(256 * np.array(e)) for i, e, _ in v if i is not None and e and None not in e and np.isfinite(e).all()}
    want = {q: sorted(((-int(ok[q] @ x), i) for i, x in ok.items() if i != q))[:5] for q in ok if q % 50 == 0 and q != 300}
    got = collections.defaultdict(list)
    for r in topk.exact_topk(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert all(got[q] == w for q, w in want.items()) and topk.exact_topk(df.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{"block": 4, "shard": 3, "batch": 2}, {"block": 1000, "shard": 1, "batch": 1}])
def test_topk_in_small_parts(spark, limits):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(6, 8)) * 4
    v = [(k, (centre[k % 6] + rng.normal(size=8) / 4).tolist()) for k in range(400)]
    m = {i: np.floor(256 * np.array(e)).astype(int) for i, e in v}
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    want = {(q, r + 1, i, -s) for q in m if q % 50 == 0 for r, (s, i) in enumerate(sorted((-int(m[q] @ x), i) for i, x in m.items() if i != q)[:5])}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_topk(df, **limits).collect()} == want
    if limits["block"] == 4:
        assert topk.skipped_share(df, **limits) > 0.5  # clusters are what bounds tell apart


@pytest.mark.parametrize("groups", [60, 3])
def test_embedding_recall(spark, groups):
    rng = np.random.default_rng(4)
    centres, spread = rng.normal(size=(groups, 16)), [0.01, 0.05, 0.1, 0.2, 0.25] * (360 // groups // 5)
    v = [(k, (c + rng.normal(size=16) * s).tolist(), k % 2) for k, (c, s) in enumerate((c, s) for c in centres for s in spread)]
    v += [(5000 + k, rng.normal(size=16).tolist(), k % 2) for k in range(400)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")
    m = np.array([e for _, e, _ in v], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = np.array([x for _, _, x in v])
    link = (m @ m.T >= 0.93) & (label[:, None] == label[None, :])
    want = dict(zip((i for i, _, _ in v), link.sum(axis=1) - 1, strict=True))
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.embedding_duplicates(df).collect()}
    assert sum(want.values()) > 50 and all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.9 * sum(want.values())


def test_pivots_grow_and_stand_apart():
    assert [vector_dedup.pivot_count(n) for n in (0, 100_000, 10**9)] == [32, 87, 1024]
    rng = np.random.default_rng(0)
    picked = np.stack(vector_dedup.pick_pivots([*(np.ones(8) + rng.normal(size=(200, 8)) / 100), *rng.normal(size=(200, 8))], 64))
    assert ((picked @ picked.T)[~np.eye(len(picked), dtype=bool)] < vector_dedup.APART).all() and len(picked) > 20


def test_embedding_dedup(spark):
    v, df = vectors(spark)
    got = {}
    for r in vector_dedup.embedding_duplicates(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[200] == [(3, 0, False)] and got[300] == [(3, 0, False)] * 2 and got[5][0][1] == 5 and got[205] == [(1, 5, False)]
    assert all(got[i] == [(0, i, True)] for i in (401, 402, 403, 404, 405, 406)) and sum(map(len, got.values())) == len(v)
    assert vector_dedup.embedding_duplicates(df.limit(0)).count() == 0


def test_vectors_with_clashing_columns(spark):
    """Columns beside those named may be called as inner ones are, and hold anything."""
    _, df = vectors(spark)
    more = df.select("*", *(F.lit(None if k % 2 else name).alias(name) for k, name in enumerate("e v point list rep near row_no dim block shard batch low n rank score query_id fine".split())))
    for run in (topk.exact_topk, vector_dedup.embedding_duplicates):
        assert sorted(map(repr, run(more).collect())) == sorted(map(repr, run(df).collect()))


def test_salted_join(spark):
    left = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(3000)] + [(99, -1), (None, -2)], "key long, v long")
    right = spark.createDataFrame([(k, f"name {k}") for k in range(8)], "key long, name string").join(left.groupBy("key").agg(F.count("*").alias("uses")), "key")
    got = sorted((r["key"], r["v"], r["name"]) for r in join_salted(left, right, ["key"], "uses", ["v"]).collect())
    assert got == sorted((r["key"], r["v"], f"name {r['key']}") for r in left.where("key < 8").collect())
    plan = join_salted(left, right, ["key"], "uses", ["v"])
    assert plan.columns == ["key", "v", "name"]


def test_components_of_a_hub(spark):
    edges = spark.createDataFrame([(5000, k) for k in range(1, 4000)] + [(4001, 4002), (4002, 5001)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {got[k] for k in [*range(1, 4000), 5000]} == {1} and {got[k] for k in (4001, 4002, 5001)} == {4001} and len(got) == 4003


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (None, 1), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and got[101] == 100 and len(got) == 42


def test_html(spark):
    page = (
        "<html><head><title>T</title></head><body><header class='site-header'><nav><a href=x>Home</a></nav></header><div id='cookie-notice'>We use cookies.</div>"
        "<article><h1>A &amp; B</h1><p>First <b>bold</b> words of the text.<br>Next  line. <p>Second.</article><div class='comments'><p>Nice! I liked it.</p></div><footer>&copy; x</footer></body></html>"
    )
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, None), (None, "u", "", "x"), (4, "u", "<p>", "x"), (1, "u", page, "y")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(df).collect()}
    assert got[1][0] == "A & B First bold words of the text. Next line. Second." and got[2] == ("", 0) and got[None] == ("", 0)
    assert html_text.extract_text(df.limit(0)).count() == 0


LONG = "A long paragraph of the text, with many words in it. It goes on and on, and then it ends."
PAGES = {
    "a form around the page": ("<form><main><article><h1>Head</h1><p>" + LONG + "</p><p>Ok.</p></article></main></form>", f"Head {LONG} Ok."),
    "blocks of a site builder": (f'<div class="x-widget"><h1>Title here</h1><div class="x-widget-container"><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></div><footer>c</footer>', f"Title here {LONG} Short. {LONG}"),
    "a quote never closed": (f'<article><p title="x>words of the text here.</p><p>{LONG}</p></article>', f"words of the text here. {LONG}"),
    "comments with long sentences": (f'<article><h1>T</h1><p>{LONG}</p><div class="comments"><div><p>{LONG}</p></div><div><p>{LONG}</p></div></div></article>', f"T {LONG}"),
    "no names at all": (f"<div><a href=a>Home</a> <a href=b>News</a></div><div><h2>A headline</h2><p>{LONG}</p><p>Really?</p><p>{LONG}</p></div><div><a href=z>Terms</a></div>", f"A headline {LONG} Really? {LONG}"),
    "a sidebar with sentences": (f'<div id="main"><p>{LONG}</p></div><div class="sidebar"><h3>About</h3><p>{LONG}</p></div>', LONG),
    "no markup": (LONG, LONG), "markup alone": ("<p><b></b>", ""), "script in it": (f"<article><p>{LONG}<script>var a='</p>';</script></p></article>", LONG),
    "a notice between": (f'<main><p>{LONG}</p><div class="cookie-notice">We use cookies.</div><p>{LONG}</p></main>', f"{LONG} {LONG}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert html_text.main_text(PAGES[name][0]) == PAGES[name][1]


def test_the_cut_decides():
    found, elements = html_text.blocks(PAGES["no names at all"][0])
    odds = dict(zip([b.text for b in found], html_text.log_odds(found, elements), strict=True))
    assert odds["Really?"] < 0 < odds[LONG] and "Really?" in html_text.main_text(PAGES["no names at all"][0])
    # A wrapper's class that holds the whole page says nothing; beside the text, it does.
    assert html_text.main_text(f'<div class="has-sidebar"><p>{LONG}</p><p>Ok.</p><div class="sidebar"><p>{LONG[:40]}.</p></div></div>') == f"{LONG} Ok."
    # Without names, a sentence in a menu's place, outside of the element with the running text, is left out by the tree alone.
    page = f"<body><div>An advert that is a whole sentence here.</div><div><h1>Head</h1><p>{LONG}</p><p>Ok.</p><p>{LONG}</p></div><div>Copyright of someone.</div></body>"
    found, elements = html_text.blocks(page)
    assert html_text.log_odds(found, elements)[0] > 0 and html_text.main_text(page) == f"Head {LONG} Ok. {LONG}"
    # The same block between lone words stays out: its neighbours decide, not its own words.
    assert "Really?" not in html_text.main_text(f"<p>{LONG}</p><div><div><p>One</p><p>Really?</p><p>Two</p></div></div>")


def test_long_page_is_cut_in_time():
    page = "<div>" + f"<p>Short</p><p>{LONG}</p>" * 10_000 + "</div>"
    assert len(html_text.main_text(page)) == 10_000 * (len(LONG) + 7) - 1


@pytest.mark.parametrize("element, count", [("article", 8_000), ("nav", 1)])
def test_long_pages_of_one_element_are_cut_in_time(element, count):
    page = f"<{element}>" + f"<p>Short</p><p>{LONG}</p><p><a href=x>A link</a></p>" * 8_000 + f"</{element}><p>{LONG}</p>"
    assert html_text.main_text(page).count(LONG) == count


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = 6
        gain = [tuple(rng.integers(0, 9, 2).astype(float)) for _ in range(n)]
        edges = [(i, j, float(rng.integers(0, 5))) for i in range(n) for j in range(i)]
        cost = lambda side: sum(b if s else a for s, (a, b) in zip(side, gain, strict=True)) + sum(c for i, j, c in edges if side[i] != side[j])  # noqa: B023,E731
        assert cost(html_text.minimum_cut(gain, edges)) == min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))


def test_licenses(spark, docs, none):
    bsd = ". ".join(licenses.SENTENCES[k][0] for k in ("BsdGrant", "BsdSource", "BsdBinary", "BsdName"))
    df = spark.createDataFrame([(1, "Text.\nReleased under the MIT License.\nMore"), (2, bsd), (3, "MIT License"), (4, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["category"]) for r in licenses.scan_licenses(df).collect()}
    assert got == {1: ("MIT", "permissive"), 2: ("BSD-3-Clause", "permissive"), 3: ("", "none"), 4: ("CC-BY-NC-4.0", "noncommercial")}
    assert licenses.scan_licenses(docs).count() == len(ROWS) and licenses.scan_licenses(none).count() == 0


CLASH = "doc_id long, text string, lang string, source string, n_chars int, row_no string, size double, position string, copy string, taken string, clean string, text_ string, spans string, component_id string, score string, row string"


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns named like everything inside the stages, nulls, empty and long texts, repeated rows and ids, ties."""
    rows = [(*r[:2], None if r[0] == 3 else "en", r[2], len(r[1] or ""), "mine", 7.0, "p", "c", "t", "k", "x", "s", "i", "z", "w") for r in ROWS]
    rows += [(12, "only once " * 30, "en", "b", 300, *([None] * 11)), (12, "a second text of one id " * 9, "en", "b", 216, *([None] * 11))]
    return spark.createDataFrame(rows, CLASH)


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "suffix_dedup", "mixing"])
def test_stages_keep_columns(spark, clashing, monkeypatch, name):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, n: s.createDataFrame([(k, 0) for k in range(60)], "doc_id long, toxic int"))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, clashing, "")
    rows = out.collect()
    assert out.columns == clashing.columns and [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema]
    mine = {(r["doc_id"], r["row_no"], r["size"], r["position"], r["copy"], r["taken"], r["clean"], r["text_"], r["row"]) for r in clashing.collect()}
    assert rows and {(r["doc_id"], r["row_no"], r["size"], r["position"], r["copy"], r["taken"], r["clean"], r["text_"], r["row"]) for r in rows} <= mine
    assert stage(spark, clashing.limit(0), "").count() == 0
    again = [tuple(r) for r in stage(spark, clashing.repartition(3, "lang"), "").collect()]
    key = lambda r: tuple(map(str, r))
    if name != "suffix_dedup":  # there, rows of one id count in stored order
        assert sorted(map(key, again)) == sorted(map(key, map(tuple, rows)))
    ids = collections.Counter(r["doc_id"] for r in rows)
    if name == "toxicity":
        assert sorted(map(key, map(tuple, rows))) == sorted(map(key, map(tuple, clashing.collect())))  # nothing toxic here
    elif name == "near_dedup":
        # 1, 2 and 7 are near copies, 5 and 6 equal; one row of 12 stays; 3, 4 and the row without an id stay.
        assert ids == {1: 1, 3: 1, 4: 1, 5: 1, 8: 1, 9: 1, 12: 1, None: 1} and {r["text"] for r in rows if r["doc_id"] == 12} == {"a second text of one id " * 9}
    elif name == "suffix_dedup":
        assert len(rows) == clashing.count() and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in rows)
        assert {r["text"] for r in rows if r["doc_id"] == 3} == {None} and {r["text"] for r in rows if r["doc_id"] == 7} == {""}
    else:
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        total = sum(words(r["text"]) for r in clashing.collect())
        assert abs(sum(words(r["text"]) for r in rows) - 1.5 * total) <= 4 and not {3, 4} & set(ids) and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_pipeline_against_plain_steps(spark, tmp_path, monkeypatch):
    """The whole run on small tables: toxic texts, copies and repeats go, what is packed is what the mix takes."""
    import corpus_pipeline

    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    clean = [" ".join(word() for _ in range(60)) for _ in range(40)]
    passage = " ".join(word() for _ in range(40))
    docs = [(k, t, "en", "ab"[k % 2], len(t)) for k, t in enumerate(clean)]
    docs += [(100 + k, clean[k], "en", "a", 1) for k in range(5)] + [(200 + k, f"vile scum go away {word()} {passage}", "en", "b", 1) for k in range(20)] + [(300 + k, f"{word()} {passage} {word()}", "en", "b", 1) for k in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(200 <= i < 300)) for i, *_ in docs], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = []
    real = corpus_pipeline.frozen
    monkeypatch.setattr(corpus_pipeline, "frozen", lambda df: kept.append(real(df)) or kept[-1])
    monkeypatch.setattr(corpus_pipeline, "drop_frozen", lambda df: None)
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    toxicity_, near, suffix, mixed = ([tuple(r) for r in k.collect()] for k in kept)
    assert {r[0] for r in toxicity_} == {i for i, *_ in docs if not 200 <= i < 300}
    assert {r[0] for r in near} == {*range(40), 300}  # the copies, and the two of 300 that differ in two words
    assert {r[0]: r[1] for r in suffix} == {i: t for i, t, *_ in docs if i in {*range(40), 300}}
    size = sum(len(r[1].split()) for r in suffix)
    assert abs(sum(len(r[1].split()) for r in mixed) - 1.5 * size) <= 4
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    want = collections.Counter((r[0], len(plain.encode(r[1], add_special_tokens=False).ids) + 1) for r in mixed)
    assert collections.Counter(zip(out.doc_id.tolist(), out.length.tolist(), strict=True)) == want  # all are shorter than a sequence
    assert (out.groupby("sequence_id").length.sum() <= 1024).all() and out.sequence_id.nunique() <= -(-out.length.sum() // 1024) + 2


def brute_ftrl(texts, labels):
    """Plain FTRL-proximal over the same features, one coordinate at a time."""
    import pyarrow as pa

    data, off = toxicity._lowered(pa.array(texts))
    row, f = toxicity.features(data, off)
    z, n, bias, nb = collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= toxicity.L1 else (np.sign(z[i]) * toxicity.L1 - z[i]) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    for _ in range(toxicity.EPOCHS):
        for r, y in enumerate(labels):
            x = sorted(set(f[row == r].tolist()))
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-min(35, max(-35, sum(w.values()) + bias))))
            for i in x:
                s = ((n[i] + (p - y) ** 2) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += (p - y) - s * w[i]
                n[i] += (p - y) ** 2
            nb += (p - y) ** 2
            bias -= toxicity.ALPHA / (toxicity.BETA + nb**0.5) * (p - y)
    return {i: weight(i) for i in z if abs(z[i]) > toxicity.L1}, bias


def test_ftrl_against_plain_steps():
    import pyarrow as pa

    texts = [("bad awful words " if k % 3 == 0 else "good nice words ") + f"and t{k % 7} more" for k in range(200)]
    labels = np.array([k % 3 == 0 for k in range(200)], float)
    data, off = toxicity._lowered(pa.array(texts))
    row, f = toxicity.features(data, off)
    kept, values, bias = toxicity.fit_ftrl([np.unique(f[row == r]) for r in range(200)], labels)
    want, want_bias = brute_ftrl(texts, labels)
    assert len(kept) and dict(zip(kept.tolist(), values.tolist(), strict=True)) == pytest.approx(want, rel=1e-4) and bias == pytest.approx(want_bias)


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    scored = toxicity.score_toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).where("held_out")
    rows = scored.join(spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null"), "doc_id").collect()
    toxic, fine = [[r["predicted"] for r in rows if r["toxic"] == y] for y in (1, 0)]
    assert sum(fine) <= 0.02 * len(fine) and len(toxic) > 50 and sum(toxic) >= 0.7 * len(toxic)  # about 3,200 labelled rows to learn from


def test_pipeline_near_dedup_at_80(spark):
    import corpus_pipeline

    near = BASE.split()
    near[30] = "other"
    words = [f"w{k}" for k in range(100)]
    far = [*words[:12], "x1", *words[13:60], "x2", *words[61:]]
    df = spark.createDataFrame([(1, BASE, 0), (2, " ".join(near), 0), (3, " ".join(words), 0), (4, " ".join(far), 0), (5, " ".join(words[:60] + ["y"] * 40), 0)], "doc_id long, text string, n_chars int")
    share = lambda a, b: len(a & b) / len(a | b)
    sets = {r["doc_id"]: {tuple(r["text"].split()[i : i + 5]) for i in range(len(r["text"].split()) - 4)} for r in df.collect()}
    assert 0.8 < share(sets[1], sets[2]) < 0.85 and 0.8 < share(sets[3], sets[4]) < 0.85 and share(sets[3], sets[5]) < 0.8
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {1, 3, 5}
    assert all(r["kept"] for r in near_dedup.near_duplicates(df).collect())


def test_topk_of_repeated_rows(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [9.0, 0.0])] * 5 + [(k, [float(k) / 10, 0.0]) for k in range(10, 20)] + [(8, [3.0, 1.0]), (8, [3.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in topk.exact_topk(df).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(1, 7), (2, 8), (3, 8), (4, 19), (5, 18)]


def test_licenses_over_lines(spark):
    full = {
        "MIT": ["MitGrant", "MitInclude", "AsIs"], "ISC": ["IscGrant"], "GPL-3.0-or-later": ["GplFree"], "BSD-3-Clause": ["BsdGrant", "BsdSource", "BsdBinary", "BsdName"],
        "BSD-2-Clause": ["BsdGrant", "BsdSource", "BsdBinary"], "Apache-2.0": ["ApacheNotice", "ApacheComply", "ApacheCopy"], "MPL-2.0": ["MplNotice"],
    }
    wrap = lambda s, n, lead="", end="\n": end.join(lead + x for x in textwrap.wrap(s, n))
    rows, want = [], []
    for name, sentences in licenses.SENTENCES.items():
        for s in sentences:
            for text in (s, f"Title\n{s}.\nMore", wrap(s, 80), f"Head\n\n{wrap(s, 40)}\n\nTail", wrap(s, 40, " * ", "\r\n")):
                rows.append((len(rows), text))
                want.append((name, None))
    for licence, names in full.items():
        for n in (80, 30):
            rows.append((len(rows), "Some License\n\nCopyright (c) 2020 A. Person\n\n" + "\n\n".join(wrap(licenses.SENTENCES[k][0] + ".", n) for k in names)))
            want.append((",".join(names), licence))
    bsd = "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n" + "\n".join(wrap(licenses.SENTENCES[k][0] + ("" if k == "BsdGrant" else "."), 80) for k in full["BSD-3-Clause"])
    rows += [(len(rows), bsd), (len(rows) + 1, "Permission to\n\nuse. All rights\n\nreserved. All. Rights reserved. Not all rights reserved")]
    want += [("AllRights,BsdGrant,BsdSource,BsdBinary,BsdName", "BSD-3-Clause,Proprietary"), ("", "")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (k, text), (ids, licence) in zip(rows, want, strict=True):
        assert got[k]["sentence_ids"] == ids and (licence is None or got[k]["licenses"] == licence), text
        assert got[k]["n_sentences"] == len([x for x in ids.split(",") if x])


def test_declared_licences(spark):
    texts = {
        "# SPDX-License-Identifier: MIT OR Apache-2.0": ("MIT,Apache-2.0", "permissive"), "/* spdx-license-identifier: (gpl-2.0-only WITH Classpath-exception-2.0) */": ("GPL-2.0-only", "copyleft"),
        "SPDX-License-Identifier: BSD-3-Clause.\nSPDX-License-Identifier: MIT and\nReleased under the MIT License.": ("MIT,BSD-3-Clause", "permissive"),
        "SPDX-License-Identifier:": ("", "none"), "SPDX-License-Identifier: NoSuch-1.0": ("", "none"), "Licensed under CC BY-NC-SA 4.0": ("CC-BY-NC-SA-4.0", "noncommercial"),
        "Licensed under CC BY-ND 4.0": ("CC-BY-ND-4.0", "other"), licenses.SENTENCES["Gpl2Free"][0]: ("GPL-2.0-or-later", "copyleft"),
        licenses.SENTENCES["ZlibAsIs"][0] + ".\n\n" + licenses.SENTENCES["ZlibGrant"][0]: ("Zlib", "permissive"),
    }
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["licenses"], r["category"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: texts[t] for k, t in rows} and len(licenses.known_ids()) >= 40
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(k, t) for k, t in rows if ";" not in t], columns=["doc_id", "text"]))
    assert {r[0]: (r[3], r[4]) for r in con.execute(queries.oracle_sql()["op9_licenses"]).fetchall()} == {k: texts[t] for k, t in rows if ";" not in t}


def test_mixing_writes_the_plan(docs, monkeypatch):
    plans = []
    kept = mixing.frozen

    def seen(df):
        out = kept(df)
        if "position" in df.columns:
            plans.append(out)
        return out

    monkeypatch.setattr(mixing, "frozen", seen)
    taken = sum(r["taken"] for r in mixing.mix_documents(docs).collect())
    (plan,) = plans
    rows = plan.withColumn("part", F.input_file_name()).collect()
    assert sum(r["taken"] for r in rows) == taken and all(0 <= r["position"] <= 1 for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["part"]].append(r["position"])
    ranges = sorted((p[0], p[-1]) for p in by.values())
    assert all(p == sorted(p) for p in by.values()) and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_mixing_moves_a_text_once_to_its_part(spark, docs):
    """No exchange is between the join with the sums of parts and the window in them, even if nothing is broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(name)
    try:
        spark.conf.set(name, "-1")
        rows = mixing.prepared(docs)
        lines = mixing.schedule(rows, mixing.frozen(mixing.source_targets(rows)))._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set(name, kept)
    first = next(i for i, x in enumerate(lines) if "Window [" in x)
    join = next(i for i, x in enumerate(lines) if i > first and "SortMergeJoin" in x)
    assert not [x for x in lines[first:join] if "Exchange" in x]


def test_mixing_of_nameless_sources(spark):
    """A null source and an empty one are two sources."""
    rows = [(k, "one two three " * (k % 4 + 1), [None, "", "a"][k % 3]) for k in range(60)]
    got = mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += len(r["text"].split())
    want = {r["source"]: round(r["target"]) for r in mixing.source_targets(spark.createDataFrame([(s, 3 * (k % 4 + 1)) for k, _, s in rows], "source string, size long")).collect()}
    assert dict(taken) == want and len(want) == 3


def test_repeats_store_a_text_once(spark, docs, monkeypatch):
    """The row goes to the shared folder as it is, without a copy of its text."""
    stored, plain = [], repeats.frozen
    monkeypatch.setattr(repeats, "frozen", lambda df: stored.append(df.columns) or plain(df))
    assert repeats.without_repeats(docs).count() == len(ROWS)
    assert sum("row" in c or "text" in c for c in stored) == 1 and ["row", "row_no"] in stored


def test_letters_and_marks_are_encoded_once():
    """Without spaces kept, a word in other cases and with other marks behind it is not encoded again."""
    enc = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), False)
    texts = ["Unwordly, unwordly UNWORDLY. (x) a-b", None, "unwordly!\tÉtéunwordly?! unwordly", ""]
    ids, n = enc.column(pa.array(texts))
    want = [enc.whole(t or "") for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()
    assert set(enc.known) == {"", "unwordly", "étéunwordly", ",", ".", "!", "?!", "(x)", "(x", ")", "a-b"}


def test_every_simple_letter_is_lowered_alike():
    enc = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), False)
    texts = [f"a{chr(c)}{chr(c)}b" for c in range(0x41, 0x250)]
    ids, n = enc.column(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [enc.whole(t).tolist() for t in texts]


def test_cuts_do_not_depend_on_blocks(monkeypatch):
    ids, ends = np.random.default_rng(4).integers(0, 50_000, 20_000).astype(np.uint32), np.array([7, 9_000, 9_001, 20_000])
    want = store.cut_points(ids, ends)
    for block in (1, 17, 999):
        monkeypatch.setattr(store, "ROLL", block)
        assert store.cut_points(ids, ends) == want
    assert sum(map(len, want)) > 40
