"""Exact, fast encoding with the public ``word_bpe_49k.json`` tokenizer.

The tokenizer splits a normalised text into words before it merges bytes inside each word, so the
ids of a text are the ids of its words in order. Words are cut and grouped by hash for a whole slice
of documents at once, each distinct word is encoded once by the ``tokenizers`` library, and the rest
are table lookups. A word is compared sign by sign with the first of its group, and that one with the
word remembered under its hash, so no result rests on a hash. Texts with anything whose normalisation
is not one code point to one (or with a special string) go through the library whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa

from .common import SpanHasher, equal_spans

VOCABULARY = "word_bpe_49k.json"
#: Words and signs remembered in a worker; beyond either the memory starts anew.
CACHE_WORDS, CACHE_SIGNS = 1 << 20, 1 << 25
_LIMIT = 0x250
_S, _L, _N, _O, _BAD = 0, 1, 2, 3, 4
#: Stands for the hash of a word that shares its hash with another one of its slice.
_NO_HASH = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of the code points below U+0250, where NFC changes nothing."""
    kind, lower = np.full(_LIMIT + 1, _BAD, dtype=np.uint8), np.arange(_LIMIT + 1, dtype=np.uint16)
    for c in range(_LIMIT):
        ch = chr(c)
        if c in (9, 10, 11, 12, 13, 32):
            kind[c] = _S
        elif 0x20 < c < 0x7F or c >= 0xA1:
            cat, low = unicodedata.category(ch)[0], ch.lower()
            if len(low) == 1 and ord(low) < _LIMIT:
                kind[c] = _L if cat == "L" else _N if cat == "N" else _O
                lower[c] = ord(low)
    return kind, lower


class _Pile:
    """A numpy array that grows at its end."""

    def __init__(self, dtype, values=()):
        self.room, self.n = np.empty(1 << 12, dtype=dtype), 0
        self.add(np.asarray(values, dtype=dtype))

    def add(self, values: np.ndarray) -> None:
        upto = self.n + len(values)
        if upto > len(self.room):
            room = np.empty(2 * upto, dtype=self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : upto] = values
        self.n = upto

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class WordBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: What holds an id.
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind, self.lower = _tables()
        self.hasher = SpanHasher(seed=49_408)
        self._forget()

    def _forget(self) -> None:
        #: Sorted hashes and their slots, the many old ones and the few new ones.
        self.levels = [(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))] * 2
        #: Ids and signs of all slots, and where those of a slot begin.
        self.ids, self.at = _Pile(self.dtype), _Pile(np.int64, [0])
        self.signs, self.sign_at = _Pile(np.uint16), _Pile(np.int64, [0])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the n+1 offsets of the texts in them. A null is empty."""
        texts = [t or "" for t in texts]
        odd = [i for i, t in enumerate(texts) if not self._plain(t)]
        plain = texts
        if odd:
            plain = list(texts)
            for i in odd:
                plain[i] = ""
        ids, offsets = self._encode_plain(plain)
        if odd:
            parts, last = [], 0
            lengths = np.diff(offsets)
            for i, e in zip(odd, self.library.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
                parts += [ids[last : offsets[i]], np.asarray(e.ids, dtype=self.dtype)]
                last, lengths[i] = offsets[i], len(e.ids)
            ids = np.concatenate([*parts, ids[last:]])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
        return ids, offsets

    def _plain(self, text: str) -> bool:
        if text.isascii():
            ok = text.isprintable() or not self._odd_ascii(text)
        else:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            ok = not (self.kind[np.minimum(codes, _LIMIT)] == _BAD).any()
        return ok and not ("<|" in text and any(s in text for s in self.special))

    def _odd_ascii(self, text: str) -> bool:
        return bool((self.kind[np.frombuffer(text.encode("ascii"), dtype=np.uint8)] == _BAD).any())

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(lengths + 1)
        codes = np.frombuffer((" ".join(texts) + " ").encode("utf-16-le"), dtype=np.uint16)
        codes = self.lower[codes]
        start, end = self._words(codes)
        if not len(start):
            return np.empty(0, dtype=self.dtype), np.zeros(len(texts) + 1, dtype=np.int64)
        which, distinct = pd.factorize(self.hasher.spans(self.hasher.prefix(codes), start, end))
        first = np.full(len(distinct), -1, dtype=np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        size, head = end - start, first[which]
        same = (size == size[head]) & equal_spans(codes, start, codes, start[head], np.minimum(size, size[head]))
        odd = np.flatnonzero(~same)  # other words of the same hash
        which[odd] = len(first) + np.arange(len(odd))
        first = np.append(first, odd)
        slot = self._slots(np.append(distinct, np.full(len(odd), _NO_HASH)), codes, start[first], end[first])[which]
        at = self.at.all
        n = at[slot + 1] - at[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(total[-1]) + np.repeat(at[slot] - total[:-1], n)
        words_before = np.searchsorted(start, ends, side="left")
        return self.ids.all[take], np.concatenate([[0], total[words_before]])

    def _words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the pre-tokens: runs of letters, single digits, runs of other signs, and contractions."""
        kind = self.kind[codes]
        cut = np.empty(len(kind), dtype=bool)
        cut[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == _N
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(kind))
        keep = kind[start] != _S
        start, end = start[keep], end[keep]
        quote = np.flatnonzero((codes[start] == 39) & (end - start == 1))
        if len(quote):
            quote = quote[quote + 1 < len(start)]
            quote = quote[(start[quote + 1] == end[quote]) & (kind[end[quote]] == _L)]
            at = end[quote]
            a, b = codes[at], codes[np.minimum(at + 1, len(codes) - 1)]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = np.zeros(len(at), dtype=bool)
            for x, y in ("re", "ve", "ll"):
                two |= (a == ord(x)) & (b == ord(y))
            size = np.where(one, 1, np.where(two, 2, 0))
            quote, size = quote[size > 0], size[size > 0]
            if len(quote):
                start, end = start.copy(), end.copy()
                end[quote] += size
                start[quote + 1] += size
                keep = end > start
                start, end = start[keep], end[keep]
        return start, end

    def _slots(self, hashes: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.at.n > CACHE_WORDS or self.signs.n > CACHE_SIGNS:
            self._forget()
        out = np.full(len(hashes), -1, dtype=np.int64)
        for keys, slot in self.levels:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = np.flatnonzero((keys[at] == hashes) & (hashes != _NO_HASH))
                found = slot[at[hit]]
                begin, size = self.sign_at.all[found], end[hit] - start[hit]
                same = self.sign_at.all[found + 1] - begin == size
                same[same] = equal_spans(codes, start[hit][same], self.signs.all, begin[same], size[same])
                out[hit[same]] = found[same]
        new = np.flatnonzero(out < 0)
        if len(new):
            words = [codes[s:e].tobytes().decode("utf-16-le") for s, e in zip(start[new], end[new], strict=True)]
            found, n = self._encode_words(words)
            out[new] = np.arange(len(new)) + self.at.n - 1
            self.at.add(self.at.all[-1] + np.cumsum(n))
            self.ids.add(found)
            self.sign_at.add(self.sign_at.all[-1] + np.cumsum(end[new] - start[new]))
            self.signs.add(np.frombuffer("".join(words).encode("utf-16-le"), dtype=np.uint16))
            old, recent = self.levels
            recent = self._merge(recent, (hashes[new], out[new]))
            if len(recent[0]) > 4096 + len(old[0]) // 8:
                old, recent = self._merge(old, recent), (recent[0][:0], recent[1][:0])
            self.levels = [old, recent]
        return out

    @staticmethod
    def _merge(a, b):
        keys, slot = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], slot[order]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, n, step = [], np.zeros(len(words), dtype=np.int64), 512
        lines = [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
        for i, e in enumerate(self.library.encode_batch(lines, add_special_tokens=False)):
            word = np.asarray(e.word_ids, dtype=np.int64)
            n[i * step : i * step + step] += np.bincount(word, minlength=min(step, len(words) - i * step))
            ids.append(np.asarray(e.ids, dtype=self.dtype))
        return np.concatenate(ids), n


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The encoder of this worker; its word memory outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def as_list(column: pa.Array) -> list[str | None]:
    return column.to_pylist()
