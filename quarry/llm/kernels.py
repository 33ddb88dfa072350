"""Array kernels shared by the text operators: they work on the UTF-8 bytes of
an Arrow batch, so a text is never turned into Python words.

Two kinds of hashes. `hashes` and `folded` mix 8 bytes, or two values, at a time
and not linearly, so no pattern of a text makes unlike ones agree. `span_hash`
takes any span from one running sum, which the places of each window need; it
is a polynomial modulo 2**64, which strings of 1,024 bytes and more can be made
to defeat, and is for windows of some hundred bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_powers = (np.ones(1, _U), np.ones(1, _U))
_byte_values = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)

#: ASCII white space as the contracts use it: \x20 and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 1 where a UTF-8 code point starts.
STARTS_POINT = (np.arange(256) & 0xC0) != 0x80


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 2**64)
        both = []
        for b in (_BASE, inverse):
            a = np.full(size, b, _U)
            a[0] = 1
            both.append(np.cumprod(a, dtype=_U))
        _powers = (both[0], both[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def running(data: np.ndarray) -> np.ndarray:
    """Sums S with S[0] = 0, from which span_hash takes any span's hash."""
    s = np.zeros(len(data) + 1, _U)
    np.cumsum(_byte_values[data] * powers(len(data) + 1)[0][: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes and lengths give equal hashes."""
    raw = (s[end] - s[start]) * powers(len(s))[1][start]
    return mix(raw + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


_LONE = _U(0x2F1B5A7D3C9E8641)
_ODD = _U(0x9FB21C651E98DF25)


def folded(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash for each run of counts[i] values: neighbours are mixed in pairs until one is left, so long runs take few steps."""
    out = np.zeros(len(counts), _U)
    of = np.flatnonzero(counts > 0)
    at, c, v = (np.cumsum(counts) - counts)[of], counts[of], values
    while len(of):
        one = c == 1
        out[of[one]] = v[at[one]]
        of, at, c = of[~one], at[~one], c[~one]
        if not len(of):
            break
        half = (c + 1) // 2
        end = np.cumsum(half)
        new = end - half
        left = np.repeat(at - 2 * new, half) + 2 * np.arange(end[-1])
        right = np.where(left + 1 < np.repeat(at + c, half), v[np.minimum(left + 1, len(v) - 1)], _LONE)
        v, at, c = mix(mix(v[left] + _ODD) * _ODD + right), new, half
    return mix(out + counts.astype(_U) * _U(0xD6E8FEB86659FD93))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]."""
    size = end - start
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the 8 bytes from each place on
    kept = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
    out = mix((eight[start] & kept[np.minimum(size, 8)]) + size.astype(_U) * _ODD)
    long = np.flatnonzero(size > 8)
    if len(long):
        counts = (size[long] + 7) // 8
        of = np.repeat(np.arange(len(long)), counts)
        skip = 8 * (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts))
        left = np.minimum(size[long][of] - skip, 8)
        out[long] = mix(folded(mix(eight[start[long][of] + skip] & kept[left]), counts) + size[long].astype(_U) * _ODD)
    return out


def runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start:end] of all runs, one after another, and their counts."""
    counts = end - start
    return values[np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())], counts


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null is empty."""
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    if not len(a) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def words(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs outside is_space) and, for each document, the first word's number (n + 1 of them)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~is_space[data]
    edge = np.diff(inside)
    first = edge == 1
    last = edge == -1
    # a text that ends in a word and one that starts with one meet: cut there
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    first[cuts] = True
    last[cuts] = True
    starts, ends = np.flatnonzero(first[: len(data)]), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)


def ngram_hash(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, in one array over all documents."""
    m = max(0, len(word_hash) - n + 1)
    h = np.zeros(m, _U)
    for i in range(n):
        h = h * _U(0x2545F4914F6CDD1D) + word_hash[i : i + m]
    return mix(h)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
