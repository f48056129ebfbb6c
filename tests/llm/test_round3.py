"""Token alignment, spelling variants and WARC archives, against plain versions."""

import collections
import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from aislelens.llm import align, variants, warc
from aislelens.llm.common import new_folder
from aislelens.llm.tokens import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
LONG = "Thorough eineinander, déjà vu: naïve façade 12345 " * 300
TEXTS = [
    "Hello world, this is a token.", "Hello world, this is a token.", None, "", " ", "a", " two  spaces ", "line\nbreak\n\n end", "tab\tand nbsp", "▁ piece mark", "<|endoftext|> and <s> plain </s> <0x41>",
    "日本語のテキスト と 漢字 混在", "emoji 👩‍👩‍👧‍👧 🎉🎉", "ﬁ ligature é é", "x" * 400, "=" * 333, "don't we'll they're", "Ünïcödé ÀÉÎ " * 9, LONG, "\x00 nul", "café", "ﷺ",
]
CLASH = "doc_id long, text string, row_no string, pair string, pos string, value string, uses string, n string, word string"


def clashing(spark, texts, first=1):
    return spark.createDataFrame([(i, t, *["clash"] * 7) for i, t in enumerate(texts, first)], CLASH)


# ------------------------------------------------------------ token alignment
def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back, more = {chr(b): b for b in printable}, 0
    for b in range(256):
        if b not in printable:
            back[chr(256 + more)] = b
            more += 1

    def piece(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs = []
    for t in texts:
        a, b = ([], []) if not t else (ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t))
        ba, bb = [bytes(back[c] for c in ta.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            docs.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            ni, nj = ea.index(end) + 1, eb.index(end) + 1
            groups.append((a[i:ni], b[j:nj]))
            i, j = ni, nj
        docs.append((a, b, groups, [(x, y) for u, v in groups for x in u for y in v]))
    count = collections.Counter(p for d in docs if d for p in set(d[3]))
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        told = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(told.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    import glob

    more = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] if glob.glob("/root/testdata/sf0.001/documents.parquet") else []
    return TEXTS + more


@pytest.mark.parametrize("limits", [{}, {"TEXT_BYTES": 300, "EXPAND": 7, "KNOWN_BYTES": 500}])
def test_alignment(spark, texts, monkeypatch, limits):
    if limits:  # workers get their own module, so small limits are tried in this process
        for k, v in limits.items():
            monkeypatch.setattr(align, k, v)
        pair = align.TokenPair(A, B, limits["KNOWN_BYTES"])
        width, want = len(pair.bytes_b), brute_alignment(texts)
        for _ in range(2):
            x = align.align(pair, pa.array(texts, pa.string()))
            doc, key, n = align.links_of(x, width)
            assert align._per_doc(n, doc, len(texts)).tolist() == [w[3] for w in want]
            whole = align.Aligned(x.ids, x.ends, x.count, x.group, x.groups)
            monkeypatch.setattr(align, "EXPAND", 1 << 21)
            assert all((p == q).all() for p, q in zip((doc, key, n), align.links_of(whole, width), strict=True))
            monkeypatch.setattr(align, "EXPAND", limits["EXPAND"])
        return
    got = sorted(tuple(r) for r in align.alignment_links(clashing(spark, texts), A, B).collect())
    assert got == [(i, *w) for i, w in enumerate(brute_alignment(texts), 1)]


def test_alignment_of_nothing(spark):
    assert align.alignment_links(clashing(spark, []), A, B).count() == 0
    assert [tuple(r) for r in align.alignment_links(clashing(spark, [None, ""]), A, B).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    got = align.alignment_links(spark.createDataFrame([(None, "same words"), (None, "same words")], "doc_id long, text string"), A, B).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["count_sum"] == 2 * got[0]["n_links"]


def test_aligned_tokens(spark, texts):
    for r in align.aligned_tokens(clashing(spark, texts), A, B).collect():
        text, pair = texts[r["doc_id"] - 1], align.token_pair(A, B)
        if r["a_ids"]:
            raw, begin = (" " + text).encode(), 0
            for a, b, end in zip(r["a_ids"], r["b_ids"], r["byte_ends"], strict=True):
                assert b"".join(pair.bytes_a[i] for i in a) == raw[begin:end] == b"".join(pair.bytes_b[i] for i in b)
                begin = end
            assert begin == len(raw)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=30, unique=True), st.lists(st.integers(1, 40), min_size=1, max_size=30, unique=True))
def test_elementary_intervals(a, b):
    a, b = (np.array(sorted({*x, 41})) for x in (a, b))
    ga, gb, n = align.groups_of(a, b)
    shared = sorted({*a.tolist()} & {*b.tolist()})
    assert n == len(shared) and ga.tolist() == [sum(s < x for s in shared) for x in a] and gb.tolist() == [sum(s < x for s in shared) for x in b]


# ------------------------------------------------------------ spelling variants
def brute_words(rows, least=7, count=2, drop=31):
    found = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if drop and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio=10):
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w]) or 0) for w, n in words.items())


def as_rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("seed", range(2))
def test_variants_brute(spark, seed):
    rng = np.random.default_rng(seed)
    letters = list("ab") if seed % 2 else list("abcé×ÿ")
    words = {"".join(rng.choice(letters, rng.integers(1, 7))): int(10 ** rng.uniform(0, 5)) for _ in range(160)}
    got = variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert as_rows(got) == brute_variants(words)


def test_variants_edges(spark):
    long = "q" * 30_000
    words = {"a": 5, "aa": 50, "aaa": 500, "aab": 500, "aaaa": 5000, "ab": 50, "b": 1, "abc": 7, long: 2, long + "z": 30, "z" + long: 30, "A": 1, "é": 3}
    assert as_rows(variants.spelling_variants(spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long"))) == brute_variants(words)
    assert variants.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert [r["root"] for r in variants.spelling_variants(spark.createDataFrame([("alone", 4)], "word string, n long")).collect()] == ["alone"]


def test_document_words(spark):
    base = "Sentence containing différent words, ÉTRANGÈRES and therefore×naturally anything; "
    rows = [(i, base * (1 + i % 3) + ("x" * 9000 if i < 2 else "")) for i in range(40)] + [(7, None), (None, base), (8, ""), (7, base), (7, base)]
    docs = clashing(spark, [], 1).unionByName(spark.createDataFrame([(i, t, *["clash"] * 7) for i, t in rows], CLASH))
    want = brute_words(rows)
    assert {r["word"]: r["n"] for r in variants.document_words(docs, drop_one_in=31).collect()} == want
    assert as_rows(variants.spelling_variants(variants.document_words(docs, drop_one_in=31))) == brute_variants(want)
    assert {r["word"]: r["n"] for r in variants.document_words(docs, least=2, count=1).collect()} == brute_words(rows, 2, 1, None)


# ------------------------------------------------------------ WARC
PAGE = "<html><body>" + "some text of a page " * 20 + "</body></html>"
PAGES = [
    (5, "http://a/5", PAGE), (2, "http://a/2", PAGE), (2, "http://a/2", PAGE), (9, None, PAGE), (1, "http://a/1", "short"), (3, "http://a/3", "short"), (4, "http://a/4", None), (6, "http://a/6", ""),
    (None, "http://a/n", PAGE), (7, "http://ä/\r\nX: y", "é" * 50), (8, "u", "é" * 50), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 30), (11, "u", "y" * 300_000), *((100 + k, f"http://b/{k}", f"<p>page {k} " + "words and more words " * 30 + str(k * k)) for k in range(200)),
    (None, "u", "nobody " * 40), (None, "u", "nobody " * 40),
]


def brute_pages(rows):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100:
            first.setdefault(h, []).append(i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), *(["response", None] if len(h) < 100 or len(first[h]) == 1 else [None, None])))
    for h, ids in first.items():
        if len(ids) > 1:
            known = [i for i in ids if i is not None]
            low, done = min(known) if known else None, False
            for k, r in enumerate(out):
                if r[2] == hashlib.sha256(h).hexdigest():
                    if r[0] == low and not done:
                        out[k], done = (*r[:3], "response", None), True
                    else:
                        out[k] = (*r[:3], "revisit", low)
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in PAGES], "page_id long, url string, html string, digest string, row_no string, uses string, first_row string").repartition(3)


def test_warc_round_trip(spark, pages):
    folder = new_folder(spark, "warc")
    manifest = warc.write_archives(pages, folder, limit=20_000)
    records = warc.read_archives(manifest, folder)
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES) == records.count()
    assert sorted([tuple(r) for r in warc.resolved_pages(records).collect()], key=str) == brute_pages(PAGES)
    told = {r["page_id"]: (r["url"], r["payload"]) for r in records.where("record_type = 'response' and page_id is not null").collect()}
    by = {i: ((u or "about:blank").replace("\r", "%0D").replace("\n", "%0A"), (h or "").encode()) for i, u, h in PAGES}
    assert all(by[i] == (u, bytes(p)) for i, (u, p) in told.items())
    again = warc.read_archives(warc.list_archives(spark, folder), folder, payloads=False)
    assert again.count() == len(PAGES) and again.where("payload is not null").count() == 0


def test_warc_of_nothing(spark, pages):
    folder = new_folder(spark, "warc")
    manifest = warc.write_archives(pages.where("false"), folder)
    assert manifest.count() == 0 and warc.resolved_pages(warc.read_archives(manifest, folder)).count() == 0


def archive(tmp_path, n=300):
    w = warc.ArchiveWriter(str(tmp_path), "one")
    raws = [warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:{k}>"), ("WARC-Date", "2024-01-01T00:00:00Z")], f"block {k} {'and the same words again ' * 40}".encode()) for k in range(n)]
    for r in raws:
        w.add(r)
    w.close()
    (name, count, size), = w.done
    data = (tmp_path / name).read_bytes()
    assert count == n and size == len(data)
    return raws, data


def test_archive_is_plain_zstandard(tmp_path):
    raws, data = archive(tmp_path)
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    whole = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True).read()
    assert whole == b"".join(raws)
    for piece in (1, 7, 1 << 20):
        assert [r for _, r in warc.read_frames(io.BytesIO(data), "x", piece)] == raws
    # A dictionary that is not compressed, frames to be passed over, and an archive without a dictionary.
    plain = dictionary.as_bytes()
    other = (0x184D2A5D).to_bytes(4, "little") + len(plain).to_bytes(4, "little") + plain + data[8 + size :] + (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    assert [r for _, r in warc.read_frames(io.BytesIO(other), "x")] == raws
    bare = b"".join(map(zstandard.ZstdCompressor().compress, raws[:3]))
    assert [r for _, r in warc.read_frames(io.BytesIO(bare), "x")] == raws[:3] and list(warc.read_frames(io.BytesIO(b""), "x")) == []


def test_damaged_archives(tmp_path):
    raws, data = archive(tmp_path, 40)
    rng = np.random.default_rng(0)
    for cut in rng.integers(1, len(data), 40).tolist():
        try:
            got = [r for _, r in warc.read_frames(io.BytesIO(data[:cut]), "x")]
        except warc.BadArchive:
            continue
        assert got == raws[: len(got)]  # cut between two frames; the number of records tells
    for at in rng.integers(0, len(data), 60).tolist():
        bad = data[:at] + bytes([data[at] ^ 0x41]) + data[at + 1 :]
        try:
            assert [r for _, r in warc.read_frames(io.BytesIO(bad), "x")] == raws
        except warc.BadArchive:
            pass


GOOD = warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:1>"), ("WARC-Date", "2024-01-01T00:00:00Z")], b"body")


@pytest.mark.parametrize("bad", [
    GOOD.replace(b"WARC/1.1", b"WARC/9.9"), GOOD.replace(b"Content-Length: 4", b"Content-Length: 5"), GOOD.replace(b"Content-Length: 4", b"Content-Length: 3"), GOOD.replace(b"Content-Length: 4", b"Content-Length: -4"),
    GOOD.replace(b"Content-Length: 4\r\n", b""), GOOD.replace(b"WARC-Type: resource\r\n", b""), GOOD.replace(b"WARC-Date: ", b"WARC Date "), GOOD[:-2], GOOD + b"x", GOOD.replace(b"\r\n\r\nbody", b"\r\nbody"),
    GOOD.replace(b"WARC-Type: resource", b"WARC-Type: resource\r\nWARC-Type: resource"), GOOD.replace(b"WARC-Type: resource", b"WARC-Type: resource\r\nWARC-Block-Digest: sha256:00"), b"",
])
def test_bad_records(bad):
    assert warc.parse_record(GOOD)[1] == b"body"
    with pytest.raises(warc.BadArchive):
        warc.parse_record(bad)


def test_payload_digests():
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\n"
    told = {"warc-type": "response", "warc-payload-digest": "sha256:" + hashlib.sha256(b"hi").hexdigest()}
    assert warc.http_payload(told, http + b"hi")[1:] == (2, hashlib.sha256(b"hi").hexdigest())
    for headers, block in ((told, http + b"ho"), (told, http + b"hi!"), (told | {"warc-type": "revisit", "warc-refers-to": "<x>"}, http + b"hi"), (told | {"warc-type": "revisit"}, http), ({"warc-type": "revisit", "warc-refers-to": "<x>"}, http)):
        with pytest.raises(warc.BadArchive):
            warc.http_payload(headers, block)


def test_revisits_must_agree(spark):
    row = ("a", 0, "response", "<1>", 1, "u", "d", 200, "x", None, None)
    ok = ("a", 9, "revisit", "<2>", 2, "u", "d", 200, "x", "<1>", None)
    good = spark.createDataFrame([row, ok], warc.RECORD)
    assert {tuple(r) for r in warc.resolved_pages(good).collect()} == {(1, 200, "x", "response", None), (2, 200, "x", "revisit", 1)}
    for bad in ((*ok[:7], 201, *ok[8:]), (*ok[:8], "y", *ok[9:]), (*ok[:9], "<3>", None)):
        with pytest.raises(Exception, match="no response is what"):
            warc.resolved_pages(spark.createDataFrame([row, bad], warc.RECORD)).collect()
