"""Every word of a repeated paragraph belongs to a unit that is compared, however short its sentences and lines are."""

import random

import numpy as np
import pyarrow as pa
from small_texts import prose
from test_near_paragraphs import kept, words

from quarry.llm import kernels as K
from quarry.llm import paragraphs as P


def test_pieces_cover_every_word():
    r = random.Random(6)
    texts = ["\n".join(prose(r.choice([1, 3, 7, 20, 90]), r) for _ in range(r.randint(1, 6))) for _ in range(60)] + ["", None, "a. b. c. d", " \n"]
    data, offsets = K.utf8(pa.array(texts, pa.string()))
    word, _, _, _, a, b, at = P.units(data, offsets)
    for part in (0, 1):
        own = at & 1 == part
        assert np.array_equal(np.sort(np.concatenate([np.arange(x, y) for x, y in zip(a[own], b[own], strict=True)])), np.arange(len(word)))
    assert (b - a)[at & ((1 << P.LINE_BITS) - 1) > 1].min() >= P.LEAST  # pieces of lines that have several


def test_copies_leave_nothing(spark):
    r = random.Random(7)
    plain = " ".join(words(60, r))  # no full stop: cut by its words
    short = " ".join(" ".join(words(r.randint(1, 6), r)) + "." for _ in range(20))  # short sentences
    poem = "\n".join(" ".join(words(r.randint(1, 7), r)) for _ in range(20))  # short lines
    texts = [plain, short, poem, f"{prose(30, r)}\n{plain}", f"{short}\n{prose(30, r)}", poem]
    got = kept(spark, texts)
    assert got[:3] == texts[:3]
    assert got[3] == texts[3].removesuffix(plain) and got[4] == texts[4].removeprefix(short) and not got[5].strip()
