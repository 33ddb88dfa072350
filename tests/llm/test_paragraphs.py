import numpy as np
import pyarrow as pa

from quarry.llm import kernels as K
from quarry.llm import paragraphs as P


def units(texts):
    data, offsets = K.utf8(pa.array(texts, pa.string()))
    _, starts, ends, at = P.cut(data, offsets)
    raw, out = data.tobytes(), [[] for _ in texts]
    for a, b in zip(at[:-1], at[1:], strict=True):
        doc = int(np.searchsorted(offsets, starts[a], "right")) - 1
        out[doc].append(raw[starts[a] : ends[b - 1]].decode())
    return out


def test_cut_does_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    texts = [" ".join("w%d" % i for i in rng.integers(0, 500, n)) for n in (200, 3, 90, 0, 33, 400)]
    together = units([*texts, None, ""])
    assert together == [units([t])[0] for t in texts] + [[], []]
    assert [" ".join(u) for u in together[:6]] == texts
    assert max(len(u.split()) for t in together for u in t) < 120


def test_sentences_and_lines():
    assert units(["One two. Three four!\nfive\n\n six? seven"]) == [["One two.", "Three four!", "five", "six?", "seven"]]
