"""Token ids of whole Arrow columns: tokenizers does the encoding, once for each different word."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes, about, of words and ids that an encoder remembers before it starts afresh, and what a word takes beside its text.
KNOWN_BYTES, PER_WORD = 64 << 20, 200
#: White space and controls on which libraries may differ; a text with one is encoded as a whole.
_ODD = "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]"
#: Latin letters and closing marks: a pre-token, and one more for the marks (any marks but an apostrophe would do).
_SIMPLE = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[.,;:!?&#*$%)\\]}]*"
_MARKS = ".,;:!?&#*$%)]}"
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level vocabularies name a byte by itself if it prints, else by the next character from 0x100 on.
_NAMES = {b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in _PLAIN)}
#: A byte's name in UTF-16, by the byte; a line end is itself.
_SHOWN = np.arange(256).astype("<u2")
_SHOWN[[b for b in _NAMES if b != 10]] = [c for b, c in _NAMES.items() if b != 10]
_LETTERS = f"^[^{re.escape(_MARKS)}]+"
_open: dict[tuple[str, bool], Encoder] = {}


def vocabulary(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as `Tokenizer.encode(text, add_special_tokens=False)` of the file's tokenizer gives them.

    Known words are remembered, in KNOWN_BYTES at most; beyond, those stay that are met again.

    spaced: a word keeps the space before it (byte-level vocabularies). White space then only
    ever ends a pre-token before a space or is one itself, so a text may be cut before each
    single space between words; without `spaced`, white space is dropped and is a cut anywhere.
    A text where that is not plain (a space beside other white space, odd controls, a special
    string of the vocabulary such as an end mark) is encoded as a whole.
    """

    def __init__(self, path: str, spaced: bool, limit: int = KNOWN_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.limit = spaced, limit
        self.simple = f"^{_SIMPLE}$"
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.odd = "|".join([_ODD, *(["\\s |^ | \\s| $"] if spaced else []), *(re.escape(t.content) for t in added)])
        if any(t.normalized for t in added):  # found in the normalised text only
            self.odd = "(?s)^.*$"
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.ids, self.start = array("I"), array("q", [0])

    def keep(self, words: list[str]) -> None:
        """Forgets all but `words`."""
        known, ids, start = self.known, self.ids, self.start
        self.forget()
        for w in words:
            k = known[w]
            self._keep(w, ids[start[k] : start[k + 1]])

    def size(self) -> int:
        """Bytes remembered, about."""
        return self.letters + PER_WORD * len(self.known) + 4 * len(self.ids)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _part(self, x: str) -> int:
        """Index of a word's part, encoded if it is new. A word of Latin letters is one pre-token
        and goes to the vocabulary's model straight, as the bytes' printable names."""
        k = self.known.get(x)
        if k is None:
            letters = x[1:] if self.spaced and x[0] == " " else x
            # U+0130 in lower case is a letter and a mark: two pre-tokens.
            if letters.isalpha() and max(letters) < "\u0250" and (self.spaced or "\u0130" not in letters):
                if not self.spaced:
                    x_ = unicodedata.normalize("NFC", x).lower()
                else:
                    x_ = x
                got = [t.id for t in self.tokenizer.model.tokenize(x_.encode().decode("latin-1").translate(_NAMES))]
            else:
                got = self.tokenizer.encode(x, add_special_tokens=False).ids
            k = self._keep(x, got)
        return k

    def _keep(self, word: str, ids: list[int] | array) -> int:
        self.ids.extend(ids)
        self.start.append(len(self.ids))
        self.known[word] = k = len(self.start) - 2
        self.letters += len(word)
        return k

    def _learn(self, word: str) -> int:
        """Encodes a word not met before, closing marks apart from the letter before them."""
        if "\n" in word and all(lines := word.split("\n")):
            # A line end between other characters is a pre-token.
            ks = [self._part("\n")]
            for x in lines:
                ks += [self.known[x] if x in self.known else self._learn(x), ks[0]]
            return self._keep(word, [i for k in ks[1:-1] for i in self.ids[self.start[k] : self.start[k + 1]]])
        stem = word.rstrip(_MARKS)
        if len(stem) == len(word) or not stem[-1:].isalpha():
            return self._part(word)
        both = [self._part(stem), self._part(word[len(stem) :])]
        return self._keep(word, [i for k in both for i in self.ids[self.start[k] : self.start[k + 1]]])

    def _learn_simple(self, words: list[str]) -> None:
        """Encodes different words of the form _SIMPLE, spaced, that are not known: _learn() of each, in one loop."""
        known, ids, start, tokenize = self.known, self.ids, self.start, self.tokenizer.model.tokenize
        space = chr(_NAMES[0x20])
        for word in words:
            stem = word.rstrip(_MARKS)
            k = known.get(stem)
            if k is None:
                k, x = len(start) - 1, stem
                if not x.isascii():
                    x = x.encode().decode("latin-1").translate(_NAMES)
                elif x[0] == " ":
                    x = space + x[1:]
                ids.extend([t.id for t in tokenize(x)])
                start.append(len(ids))
                known[stem] = k
                self.letters += len(stem)
            if len(stem) != len(word):
                tail = word[len(stem) :]
                t = known[tail] if tail in known else self._part(tail)
                ids.extend(ids[start[k] : start[k + 1]] + ids[start[t] : start[t + 1]])
                start.append(len(ids))
                known[word] = len(start) - 2
                self.letters += len(word)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row); null is the empty text."""
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, self.odd))
        if odd.any():
            ids, n = self.column(texts.filter(pa.array(~odd)))
            even = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
            rows = [self.whole(t.as_py()) if o else next(even) for t, o in zip(texts, odd, strict=True)]
            return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        if not self.spaced:
            return self._unspaced(texts)
        lists = pc.split_pattern(texts, " ")
        per_row = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        names, code = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
        simple = np.asarray(pc.match_substring_regex(coded.dictionary, self.simple)).tolist()
        # All but a row's first word have a space before them.
        first = np.zeros(len(code), bool)
        first[(np.cumsum(per_row) - per_row)[per_row > 0]] = True
        code = np.where(first, code + len(names), code)
        firsts = set(code[first].tolist())
        names = [" " + w for w in names] + [w if i in firsts else "" for i, w in enumerate(names, len(names))]
        index = list(map(self.known.get, names))
        if self.size() > self.limit:
            # What these texts use again is worth keeping; most words come once.
            self.keep([w for w, k in zip(names, index, strict=True) if k is not None])
            index = list(map(self.known.get, names))
        known, learn = self.known, self._learn
        if "" not in known:
            self._keep("", [])
            index = list(map(known.get, names))
        new = [i for i, k in enumerate(index) if k is None]
        # `simple` is as long as the different words; after these come a row's first words, without a space.
        self._learn_simple([names[i] for i in new if i < len(simple) and simple[i]])
        for i in new:
            w = names[i]
            index[i] = known[w] if w in known else learn(w)
        ids, ends = _gathered(self.ids, self.start, np.array(index, np.int64)[code] if len(code) else code)
        return ids, _per_row(ends, per_row)

    def _unspaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """column() of texts that are not odd, where white space is dropped.

        A word of the form _SIMPLE is its letters in lower case and the marks behind them.
        Columns of words are taken apart and put together as a whole; Python sees letters, marks
        and other words that are new, each different one once, and these are what is remembered.
        """
        lists = pc.ascii_split_whitespace(texts)
        per_row = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        simple = pc.match_substring_regex(coded.dictionary, self.simple)
        both = coded.dictionary.filter(simple)
        stems = pc.dictionary_encode(pc.utf8_lower(pc.ascii_rtrim(both, characters=_MARKS)))
        marks = pc.dictionary_encode(pc.replace_substring_regex(both, _LETTERS, ""))
        names, rest = stems.dictionary.to_pylist(), [*marks.dictionary.to_pylist(), *coded.dictionary.filter(pc.invert(simple)).to_pylist()]
        if self.size() > self.limit:
            self.keep([w for w in dict.fromkeys([*names, *rest]) if w in self.known])
        known, ids, start, tokenize = self.known, self.ids, self.start, self.tokenizer.model.tokenize
        if "" not in known:
            self._keep("", [])
        if new := [w for w in names if w not in known]:
            raw = "\n".join(new).encode()
            for word, x in zip(new, _SHOWN[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le").split("\n"), strict=True):
                ids.extend([t.id for t in tokenize(x)])
                known[word] = len(start) - 1
                start.append(len(ids))
            self.letters += len(raw)
        rest = np.array([known[w] if w in known else self._learn(w) for w in rest], np.int64)
        # Each different word: its letters and its marks, or itself and nothing.
        parts = np.full((len(coded.dictionary), 2), known[""], np.int64)
        simple = np.asarray(simple)
        parts[simple, 0] = np.array([known[w] for w in names], np.int64)[np.asarray(stems.indices)]
        parts[simple, 1] = rest[np.asarray(marks.indices)]
        parts[~simple, 0] = rest[len(marks.dictionary) :]
        held, ends = _gathered(ids, start, parts.ravel())
        got, ends = _gathered(held, np.concatenate([[0], ends[1::2]]), np.asarray(coded.indices).astype(np.int64))
        return got, _per_row(ends, per_row)


def _gathered(ids: array | np.ndarray, start: array | np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words `which` one after the other, where each one ends there); word k has ids[start[k] : start[k + 1]]."""
    ids, start = np.frombuffer(ids, np.uint32), np.frombuffer(start, np.int64)
    got = pa.LargeListArray.from_arrays(pa.array(start), pa.array(ids)).take(pa.array(which)).flatten()
    return np.asarray(got), np.cumsum(start[which + 1] - start[which])


def _per_row(ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Ids of each row, which has so many `words`; ends: where the ids of each word end."""
    total, cut = np.concatenate([[0], ends]), np.cumsum(words)
    return total[cut] - total[cut - words]


def encoder(path: str, spaced: bool) -> Encoder:
    """The one encoder of this process, for the vocabulary asked for last: a Python worker runs many tasks, and words known from one serve the next."""
    if (path, spaced) not in _open:
        _open.clear()
        _open[path, spaced] = Encoder(path, spaced)
    return _open[path, spaced]


def with_end(ids: np.ndarray, count: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """`end` after the ids of each row."""
    out = np.full(len(ids) + len(count), end, np.uint32)
    mine = np.ones(len(out), bool)
    mine[np.cumsum(count + 1) - 1] = False
    out[mine] = ids
    return out, count + 1
