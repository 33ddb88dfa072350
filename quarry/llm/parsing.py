"""Prefix-free parsing of byte strings: triggers, phrases and their hashes.

A trigger is the place of the least rolling hash of TRIGGER bytes among those in
some string of `span` bytes, the rightmost of equal ones. So every string of
`span` bytes holds a trigger of its own, at the same place wherever the string
occurs; a rule such as "hash mod p = 0" gives no such bound. The starts that
share a trigger are a phrase of the parse: phrases cover all starts once.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K

TRIGGER = 48
_LOW = np.uint64(0xFFFFFFFF)


def phrases(data: np.ndarray, offsets: np.ndarray, span: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start and the trigger of each phrase, over all strings of `span` bytes within a document. s: K.running(data)."""
    n, width = len(data), span - TRIGGER + 1
    none = np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    if n < span or not (lengths >= span).any():
        return none, none, none
    grams = n - TRIGGER + 1
    at = np.arange(grams)
    value = K.span_hash(s, at, at + TRIGGER)
    value &= ~_LOW
    value |= (_LOW.astype(np.int64) - at).astype(np.uint64)
    blocks = -(-grams // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = value
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - span + 1
    least = np.minimum(back[:starts], ahead[width - 1 : width - 1 + starts])
    trigger = (_LOW - (least & _LOW)).astype(np.int64)
    fits = np.zeros(n + 1, np.int32)
    long = lengths >= span
    np.add.at(fits, offsets[:-1][long], 1)
    np.add.at(fits, offsets[1:][long] - span + 1, -1)
    fits = np.cumsum(fits[:starts]) > 0
    new = np.ones(starts, bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | ~fits[:-1]
    doc_starts = offsets[:-1][long]
    new[doc_starts] = True
    new &= fits
    first = np.flatnonzero(new)
    end = np.ones(starts, bool)
    end[:-1] = new[1:] | ~fits[1:]
    end &= fits
    return first, np.flatnonzero(end), trigger[first]
