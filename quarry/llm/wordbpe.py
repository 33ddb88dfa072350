"""Encodes texts with a word-level BPE vocabulary file exactly as its library does.

A text is cut at white space; each distinct piece is encoded once per batch and
kept, by its hash, in a bounded table. New pieces are merged all together with arrays: one
round merges the pair of lowest rank, leftmost first, in every word. Texts with
characters whose handling needs the library (its normaliser, its special
strings) or words of over LONG bytes go to the library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import kernels as K

LONG = 64
#: Pieces kept by a worker (about 40 bytes each); when full, it starts anew.
KEPT = 1_000_000
#: Characters that NFC and lower-casing treat one by one; special strings hold "<|".
_OTHER = "[^\t\n\r -~À-ÖØ-öø-ÿ“”‘’–—…€©]|<\\|"
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
#: Pieces of letters only, and not long, are one word.
_LETTERS = f"^[a-zß-öø-ÿ]{{1,{LONG // 2}}}$"
_NONE = np.int64(2**62)


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        names = _byte_names()
        self.inner = np.array([vocab[c] for c in names], np.int64)
        self.final = np.array([vocab[c + end] for c in names], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        self.bits = 20
        self.slots = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks = np.zeros(len(self.slots), np.int64)
        todo, rank, shift = key, np.arange(len(key)), 0
        while len(todo):  # linear probing, all keys of one distance together
            at = self._slot(todo) + shift
            free = self.slots[at] == -1
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(at), bool)
            put[first] = True
            put &= free
            self.slots[at[put]], self.ranks[at[put]] = todo[put], rank[put]
            todo, rank, shift = todo[~put], rank[~put], shift + 1
        self.probes = shift
        self._forget()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it doesn't merge."""
        key = a << 16 | b
        at = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        for _ in range(self.probes):
            have = self.slots[at]
            hit = have == key
            out[left[hit]] = self.ranks[at[hit]]
            go = ~hit & (have != -1)
            if not go.any():
                break
            left, key, at = left[go], key[go], at[go] + 1
        return out

    def _merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, whose bytes stand one after another, and how many each has."""
        if not len(sizes):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        n = len(data)
        ids = self.inner[data]
        ids[ends - 1] = self.final[data[ends - 1]]
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = -1
        before[starts] = -1
        alive = np.ones(n, bool)
        key = np.full(n, _NONE)

        def rate(at: np.ndarray) -> None:
            key[at] = _NONE
            at = at[following[at] >= 0]
            rank = self._rank(ids[at], ids[following[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            key[at] = rank << 32 | at

        rate(np.arange(n))
        while True:
            least = np.minimum.reduceat(key, starts)
            least = least[least < _NONE]
            if not len(least):
                break
            at = least & 0xFFFFFFFF
            right = following[at]
            ids[at] = self.merged[least >> 32]
            alive[right] = False
            key[right] = _NONE
            after = following[right]
            following[at] = after
            has = after >= 0
            before[after[has]] = at[has]
            rate(at)
            left = before[at]
            rate(left[left >= 0])
        return ids[alive].astype("<u4"), np.add.reduceat(alive, starts, dtype=np.int64)

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        plain = pc.match_substring_regex(words, _LETTERS).to_numpy(zero_copy_only=False)
        data, offsets = K.utf8(words.filter(pa.array(plain)))
        others = np.flatnonzero(~plain)
        parts, long = [], {}
        for i, x in zip(others.tolist(), words.take(pa.array(others)).to_pylist(), strict=True):
            if len(x) > LONG // 2:
                long[i] = self._by_library(x)
                parts.append([])
            else:
                parts.append([w.encode() for w in _WORD.findall(x)])
        rest = [w for p in parts for w in p]
        ids, counts = self._merge(np.concatenate([data, np.frombuffer(b"".join(rest), np.uint8)]), np.concatenate([np.diff(offsets), np.fromiter(map(len, rest), np.int64, len(rest))]))
        n = int(plain.sum())
        size, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[plain] = counts[:n]
        upto = np.concatenate([[0], np.cumsum(counts[n:])])
        of = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        size[others] = np.diff(upto[of])
        start[plain] = np.cumsum(counts[:n]) - counts[:n]
        start[others] = counts[:n].sum() + upto[of[:-1]]
        if long:
            tail = len(ids)
            for i, own in long.items():
                start[i], size[i] = tail, len(own)
                tail += len(own)
            ids = np.concatenate([ids, *long.values()])
        return K.runs(ids, start, start + size)[0], size

    def _places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct pieces start in `flat`, and how many there are; pieces are known by hashes of 64 bits."""
        data, offsets = K.utf8(words)
        key = K.hashes(data, offsets[:-1], offsets[1:])
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        new = self.keys[at] != key if len(self.keys) else np.ones(len(key), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > KEPT:
                self._forget()
                new[:] = True
            ids, size = self._new(words.filter(pa.array(new)))
            start = len(self.flat) + np.cumsum(size) - size
            keys = np.concatenate([self.keys, key[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.start, self.size = keys[order], np.concatenate([self.start, start])[order], np.concatenate([self.size, size])[order]
            self.flat = np.concatenate([self.flat, ids])
            at = np.searchsorted(self.keys, key)
        return self.start[at], self.size[at]

    def _forget(self) -> None:
        self.keys, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Each text's ids, as little-endian 32-bit integers; null has none.

        Lower-casing, splitting and the count of distinct pieces are the array
        library's; only pieces of other signs than letters are Python's.
        """
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        other = pc.match_substring_regex(column, _OTHER).to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(other), "", column)))
        pieces = lists.flatten().dictionary_encode()
        start, size = self._places(pieces.dictionary)
        which = pieces.indices.to_numpy(zero_copy_only=False)
        ids, each = K.runs(self.flat, start[which], start[which] + size[which])
        raw = ids.tobytes()
        offsets = np.asarray(lists.offsets)
        cut = (4 * np.concatenate([[0], np.cumsum(each)])[offsets - offsets[0]]).tolist()
        out = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for i in np.flatnonzero(other).tolist():
            out[i] = self._by_library(column[i].as_py()).tobytes()
        return out


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The worker's own encoder for the file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
