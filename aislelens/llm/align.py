"""Alignment of two tokenizers on the same bytes: elementary intervals, groups, links and their counts."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frozen, join_salted, passes, utf8
from .tokens import _NAMES, _ODD

#: Bytes of text in a block of documents; a longer document is a block of its own.
TEXT_BYTES = 1 << 20
#: Bytes, about, of words that a worker remembers before it starts afresh, and what a word takes beside its text.
KNOWN_BYTES, PER_WORD = 64 << 20, 220
#: Words encoded at once, as the library's results are large beside the ids.
LEARN = 2000
#: Links that are expanded at once.
EXPAND = 1 << 21
_ALONE = f"{_ODD}|\\s | \\s|^\\s|\\s$|▁"
_BYTES = {chr(c): b for b, c in _NAMES.items()} | {chr(b): b for b in range(256) if b not in _NAMES}


class TokenPair:
    """Ids and byte lengths that both tokenizers give for whole Arrow columns.

    Neither has a token that goes on over a space between two words, so in a text whose spaces
    are single ones between other characters, a word with the space before it is encoded once
    and remembered. Other texts are encoded as a whole.
    """

    def __init__(self, path_a: str, path_b: str, limit: int = KNOWN_BYTES):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.limit = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), limit
        self.a.encode_special_tokens = True
        names = self.a.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(_BYTES[c] for c in name) if all(c in _BYTES for c in name) else name.encode()
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.table_a, self.table_b = (pa.array(known, pa.large_binary()) for known in (self.bytes_a, self.bytes_b))
        self.len_a, self.len_b = (np.array([len(x) for x in known], np.int64) for known in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.ids = array("i"), array("i")
        self.start = array("q", [0]), array("q", [0])
        self.same = array("b")

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """(ids of A for space and text, ids of B for the text, do both give back space and text)."""
        spaced = [" " + t for t in texts]
        for t, x, b in zip(spaced, self.a.encode_batch_fast(spaced, add_special_tokens=False), self.b.encode(texts, num_threads=1), strict=True):
            a, raw = x.ids, t.encode()
            yield a, b, b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b])

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not known, with the space before each."""
        spaced = [" " + w for w in words]
        got = [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)], self.b.encode(words, num_threads=1)
        raw = [w.encode() for w in spaced]
        size, whole, same = np.array([len(r) for r in raw], np.int64), b"".join(raw), np.ones(len(words), bool)
        for ids, start, per_word, table, lens in zip(self.ids, self.start, got, (self.table_a, self.table_b), (self.len_a, self.len_b), strict=True):
            flat, n = np.fromiter(chain.from_iterable(per_word), np.int32), np.array([len(x) for x in per_word], np.int64)
            start.frombytes((len(ids) + np.cumsum(n)).tobytes())
            ids.frombytes(flat.tobytes())
            ends = np.concatenate([[0], np.cumsum(lens[flat])])[np.concatenate([[0], np.cumsum(n)])]
            # As a rule all bytes are given back; where they aren't, words are looked at one by one.
            _, off, data = table.take(pa.array(flat)).buffers()
            back = data.to_pybytes()[: int(ends[-1])] if len(flat) else b""
            if back != whole or (np.diff(ends) != size).any():
                same &= np.array([back[b:e] == r for b, e, r in zip(ends[:-1].tolist(), ends[1:].tolist(), raw, strict=True)], bool)
        first = len(self.same)
        self.same.frombytes(same.astype(np.int8).tobytes())
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.letters += sum(map(len, words))

    def column(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """([ids of A, of B], [how many of each row], rows whose bytes both give back). Null is the empty text, which has none."""
        texts = pc.fill_null(texts, "")
        alone = np.asarray(pc.match_substring_regex(texts, _ALONE))
        if alone.any():
            ids, n, same = self.column(texts.filter(pa.array(~alone)))
            parts = [np.split(x, np.cumsum(k)[:-1]) if len(k) else [] for x, k in zip(ids, n, strict=True)]
            even, got = iter(zip(*parts, same, strict=True)), []
            whole = self.encode([t.as_py() for t in texts.filter(pa.array(alone))])
            for odd in alone.tolist():
                a, b, ok = next(whole) if odd else next(even)
                got.append((np.asarray(a, np.int32), np.asarray(b, np.int32), ok))
            return [np.concatenate([g[k] for g in got]) for k in (0, 1)], [np.array([len(g[k]) for g in got], np.int64) for k in (0, 1)], np.array([g[2] for g in got], bool)
        lists = pc.split_pattern(texts, " ")
        per_row = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        names, code = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
        if self.letters + PER_WORD * len(self.known) > self.limit:
            self.forget()
        new = [w for w in names if w not in self.known]
        for k in range(0, len(new), LEARN):
            self.learn(new[k : k + LEARN])
        which = np.array([self.known[w] for w in names], np.int64)[code] if len(code) else code
        ids, n, cut = [], [], np.cumsum(per_row)
        for store, start in zip(self.ids, self.start, strict=True):
            begins = np.frombuffer(start, np.int64)
            parts = pa.LargeListArray.from_arrays(pa.array(begins), pa.array(np.frombuffer(store, np.int32))).take(pa.array(which)).flatten()
            total = np.concatenate([[0], np.cumsum((begins[1:] - begins[:-1])[which])]).astype(np.int64)
            ids.append(np.asarray(parts))
            n.append(total[cut] - total[cut - per_row])
        bad = np.concatenate([[0], np.cumsum(np.frombuffer(self.same, np.int8)[which] == 0)])
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
        same = (bad[cut] == bad[cut - per_row]) & ~empty
        return ids, n, same


_pairs: dict[tuple[str, str], TokenPair] = {}


def token_pair(path_a: str, path_b: str) -> TokenPair:
    """The one of this process: words known from one task serve the next."""
    if (path_a, path_b) not in _pairs:
        _pairs.clear()
        _pairs[path_a, path_b] = TokenPair(path_a, path_b)
    return _pairs[path_a, path_b]


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(group of each A token, of each B token, groups), given the ascending ends of both on the same bytes.

    All ends together cut the bytes into elementary intervals. An interval lies in one token of
    each side, so it is one overlap, and one that ends where both owners end closes a group.
    """
    edges = np.concatenate([ends_a, ends_b])
    edges.sort(kind="stable")  # two sorted runs: union1d by merging
    edges = edges[np.append(edges[1:] != edges[:-1], True)] if len(edges) else edges
    own_a, own_b = np.searchsorted(ends_a, edges), np.searchsorted(ends_b, edges)
    closes = (ends_a[own_a] == edges) & (ends_b[own_b] == edges)
    group = np.cumsum(closes) - closes
    return group[np.searchsorted(edges, ends_a)], group[np.searchsorted(edges, ends_b)], int(closes.sum())


@dataclass
class Aligned:
    """Tokens of a block of documents in groups. Documents whose bytes are not both tokenizers' have none."""

    ids: list[np.ndarray]
    ends: list[np.ndarray]  # bytes from the start of the block, the space before each text included
    count: list[np.ndarray]  # tokens of each document
    group: list[np.ndarray]
    groups: int

    @property
    def sizes(self) -> list[np.ndarray]:
        """Tokens of each group."""
        return [np.bincount(g, minlength=self.groups) for g in self.group]

    @property
    def document(self) -> np.ndarray:
        """Document of each A token."""
        return np.repeat(np.arange(len(self.count[0])), self.count[0])


def align(pair: TokenPair, texts: pa.Array) -> Aligned:
    ids, count, same = pair.column(texts)
    for k in (0, 1):
        ids[k] = ids[k][np.repeat(same, count[k])]
        count[k] = np.where(same, count[k], 0)
    ends = [np.cumsum(size[x]) for size, x in zip((pair.len_a, pair.len_b), ids, strict=True)]
    *group, groups = groups_of(*ends)
    return Aligned(ids, ends, count, group, groups)


_SEPARATORS = ",|;"
_texts: dict[int, pa.Array] = {}


def group_text(x: Aligned) -> tuple[memoryview, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all documents as ASCII, and where each one ends."""
    most = int(max((int(i.max()) for i in x.ids if len(i)), default=0)) + 1
    if most not in _texts:
        _texts.clear()
        _texts[most] = pa.array([f"{i}{s}" for i in range(most) for s in _SEPARATORS], pa.large_binary())
    (ga, gb), (na, nb) = x.group, x.sizes
    last = [np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in x.group]
    code = np.zeros(len(ga) + len(gb), np.int64)
    code[np.arange(len(ga)) + (np.cumsum(nb) - nb)[ga]] = 3 * x.ids[0].astype(np.int64) + last[0]
    code[np.arange(len(gb)) + np.cumsum(na)[gb]] = 3 * x.ids[1].astype(np.int64) + 2 * last[1]
    got = _texts[most].take(pa.array(code))
    _, offsets, data = got.buffers()
    off = np.frombuffer(offsets, np.int64)[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
    return memoryview(data if data is not None else b""), off[np.cumsum(x.count[0] + x.count[1])]


def links_of(x: Aligned, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, A id * width + B id, links) of each different id pair of each document, in order: group products expand.

    Products are expanded EXPAND links at a time; a group with a larger product counts its
    different ids first, so memory follows the different pairs.
    """
    ids_a, ids_b = (i.astype(np.int64) for i in x.ids)
    (ga, gb), (na, nb), doc = x.group, x.sizes, x.document
    first_b = np.cumsum(nb) - nb
    huge = na * nb > EXPAND
    times_a = np.where(huge[ga], 0, nb[ga]) if len(ga) else ga
    upto = np.concatenate([[0], np.cumsum(times_a)])
    docs, pairs, links = [], [], []
    span = width * (int(ids_a.max()) + 1 if len(ids_a) else 1)

    def add(d: np.ndarray, p: np.ndarray, n: np.ndarray | None) -> None:
        key = d * span + p
        order = np.argsort(key, kind="stable") if n is not None else None
        key = np.sort(key) if order is None else key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        docs.append(key[new] // span)
        pairs.append(key[new] % span)
        links.append(np.diff(np.append(new, len(key))) if order is None else np.add.reduceat(n[order], new))

    i = 0
    while i < len(ga):
        j = min(max(i + 1, int(np.searchsorted(upto, upto[i] + EXPAND, "right")) - 1), len(ga))
        rep = times_a[i:j]
        if upto[j] > upto[i]:
            a = np.repeat(np.arange(i, j), rep)
            b = first_b[ga[a]] + np.arange(len(a)) - np.repeat(upto[i:j] - upto[i], rep)
            add(doc[a], ids_a[a] * width + ids_b[b], None)
        i = j
    for g in np.flatnonzero(huge):
        mine = np.searchsorted(ga, [g, g + 1]), np.searchsorted(gb, [g, g + 1])
        (ua, ca), (ub, cb) = (np.unique(i[slice(*m)], return_counts=True) for i, m in zip((ids_a, ids_b), mine, strict=True))
        for k in range(0, len(ua), max(1, EXPAND // len(ub))):
            part = slice(k, k + max(1, EXPAND // len(ub)))
            p = (ua[part, None] * width + ub).ravel()
            add(np.full(len(p), doc[mine[0][0]]), p, (ca[part, None] * cb).ravel())
    if len(docs) > 1:
        d, p, n = (np.concatenate(v) for v in (docs, pairs, links))
        docs, pairs, links = [], [], []
        add(d, p, n)
    return (docs[0], pairs[0], links[0]) if docs else (np.zeros(0, np.int64),) * 3


def _per_doc(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(docs, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def _blob(x: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unblob(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


ALIGNED = "row_no long, doc_id long, byte_ends array<long>, a_ids array<array<int>>, b_ids array<array<int>>"


def aligned_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The groups of each document of docs (doc_id, text): where a group ends in bytes of space and text, and its A and B ids.

    A text that is null or empty, or that one of the tokenizers does not give back, has no
    groups; a repeated row is a row of its own; other columns may have any names.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(path_a, path_b)
        for batch in batches:
            for i, j in passes(utf8(batch.column("text"))[1], TEXT_BYTES):
                x = align(pair, batch.column("text").slice(i, j - i))
                sizes = x.sizes
                at = x.document[np.searchsorted(x.group[0], np.arange(x.groups))] if x.groups else np.zeros(0, np.int64)
                stops = np.searchsorted(x.group[0], np.arange(x.groups), "right") - 1
                base = np.concatenate([[0], np.cumsum(_per_doc(np.diff(np.concatenate([[0], x.ends[0]])), x.document, j - i))])
                lists = lambda ids, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                off = pa.array(np.searchsorted(at, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_no").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(off, pa.array(x.ends[0][stops] - base[at], pa.int64())),
                        *(pa.ListArray.from_arrays(off, lists(v, n)) for v, n in zip(x.ids, sizes, strict=True)),
                    ],
                    ["row_no", "doc_id", "byte_ends", "a_ids", "b_ids"],
                )

    return _rows(docs).mapInArrow(rows, ALIGNED)


def _rows(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_no", F.monotonically_increasing_id())


BLOCK = (
    "block_no long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "n_pairs array<long>, refs binary, links binary, pairs array<long>, docs array<int>"
)


def _blocks(path_a: str, path_b: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = token_pair(path_a, path_b), TaskContext.get().partitionId() << 33
        width, fields = len(pair.bytes_b), [x.split()[0] for x in BLOCK.split(", ")]
        for batch in batches:
            for i, j in passes(utf8(batch.column("text"))[1], TEXT_BYTES):
                x = align(pair, batch.column("text").slice(i, j - i))
                text, ends = group_text(x)
                begins = np.concatenate([[0], ends[:-1]]).tolist()
                told = [hashlib.sha256(text[b : e - 1]).hexdigest() if e > b else "" for b, e in zip(begins, ends.tolist(), strict=True)]
                doc, key, links = links_of(x, width)
                pairs, refs, docs = np.unique(key, return_inverse=True, return_counts=True)
                at = x.document[np.searchsorted(x.group[0], np.arange(x.groups))] if x.groups else np.zeros(0, np.int64)
                one = lambda v, kind=None: pa.array([v], kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        one(number, pa.int64()), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column("doc_id").slice(i, j - i)), one(x.count[0]), one(x.count[1]),
                        one(np.bincount(at, minlength=j - i)), one(_per_doc(links, doc, j - i)), one(told, pa.list_(pa.string())), one(np.bincount(doc, minlength=j - i)),
                        one(_blob(refs), pa.binary()), one(_blob(links), pa.binary()), one(pairs), one(docs.astype(np.int32)),
                    ],
                    fields,
                )
                number += 1

    return rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the count and best mark of each of their pairs -> documents."""
    for batch in batches:
        for k in range(len(batch)):
            block = batch.slice(k, 1)
            item = lambda c, b=block: b.column(c)[0].values
            refs, links, n = _unblob(block.column("refs")[0].as_py()), _unblob(block.column("links")[0].as_py()), np.asarray(item("n_pairs"))
            value = np.zeros(len(item("pos")), np.int64)
            value[np.asarray(item("pos"))] = np.asarray(item("value"))
            got = value[refs]
            doc = np.repeat(np.arange(len(n)), n)
            best, total = (_per_doc(v, doc, len(n)) for v in (links * (got & 1), links * (got >> 1)))
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*(item(c) for c in names[:5]), pa.array(best), pa.array(total), item("groups_sha256")], names)


def token_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Blocks of documents (BLOCK): what each document's alignment comes to, its links by pair, and the block's pairs with the documents that hold them."""
    return frozen(_rows(docs).mapInArrow(_blocks(path_a, path_b), BLOCK))


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(pair, n, uses, best) of token_blocks(): how many documents hold an id pair (A id * width + B id) linked, in how many blocks, and if no other pair of its A id is in more.

    Blocks have added up their documents before the exchange. What is broadcast has a row for
    an A id, so the vocabulary bounds it.
    """
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"), F.count("*").alias("uses"))
    counts = frozen(counts)
    a_id = F.expr(f"pair div {width}L")
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))
    return counts.withColumn("a_id", a_id).join(F.broadcast(most), "a_id").select("pair", "n", "uses", (F.col("n") == F.col("most")).alias("best"))


def alignment_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokenizer A (a byte-level vocabulary of `tokenizers`) encodes space and text, B (a
    `sentencepiece` model that puts a space before) the text. Byte offsets where tokens of both
    end cut them into groups; A and B tokens of a group are linked, each with each. An id pair
    counts the documents that hold it linked: n_best are the links whose count no other pair of
    their A id exceeds, count_sum sums the counts over links.

    A text that is null or empty, or that one of the tokenizers does not give back byte by byte,
    has zeros and ''; special strings in a text are plain text; a repeated row is a document of
    its own; a very long text is a block of its own; an empty table gives no rows; other columns
    may have any names.

    Documents are encoded once, in blocks. A block asks for the counts of its different pairs
    and not of each document's, so what is exchanged is small beside the links.
    """
    width = len(token_pair(path_a, path_b).bytes_b)
    blocks = token_blocks(docs, path_a, path_b)
    counts = pair_counts(blocks, width).select("pair", "uses", (F.col("n") * 2 + F.col("best").cast("long")).alias("value"))
    asked = join_salted(blocks.select("block_no", F.posexplode("pairs").alias("pos", "pair")), counts, ["pair"], "uses", ["block_no"])
    told = asked.groupBy("block_no").agg(F.collect_list(F.struct("pos", "value")).alias("x")).select("block_no", F.col("x.pos").alias("pos"), F.col("x.value").alias("value"))
    none = F.array().cast
    full = blocks.drop("pairs", "docs").join(told, "block_no", "left").withColumn("pos", F.coalesce("pos", none("array<int>"))).withColumn("value", F.coalesce("value", none("array<long>")))
    return full.mapInArrow(_counted, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
