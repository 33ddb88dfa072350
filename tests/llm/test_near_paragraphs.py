"""Whole paragraphs that are similar at 0.8 go, whatever was edited inside them."""

import random

from quarry.llm import paragraphs as P


def words(n, r):
    return ["w%d" % r.randrange(10**9) for _ in range(n)]


def shingles(line):
    w = line.split()
    return {tuple(w[i : i + P.WORDS]) for i in range(max(1, len(w) - P.WORDS + 1))}


def near(a, b):
    a, b = shingles(a), shingles(b)
    return 100 * len(a & b) >= P.PERCENT * len(a | b)


def kept(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["kept_text"] for r in P.without_repeats(spark, rows).orderBy("doc_id").collect()]


def test_inner_edits_of_whole_paragraphs(spark):
    r = random.Random(3)
    texts, pairs = [], []
    for n in (60, 100, 200):
        for edits in (1, 1, 1, 2, 12):
            w = words(n, r)
            other = list(w)
            for k in r.sample(range(5, n - 5), edits):
                other[k] = "edited%d" % r.randrange(10**9)
            if edits == 12:
                other[::2] = words(len(other[::2]), r)  # far apart
            pairs.append(len(texts))
            texts += [" ".join(w), " ".join(words(30, r)) + ".\n" + " ".join(other) + "\n" + " ".join(words(30, r))]
    got = kept(spark, texts)
    verdicts = set()
    for i in pairs:
        head, copy, tail = texts[i + 1].split("\n")
        verdicts.add(near(texts[i], copy))
        assert got[i] == texts[i]
        if near(texts[i], copy):
            assert got[i + 1] == "\n".join([head, "", tail])
        else:  # equal pieces of it may go, but no edited one
            left = got[i + 1].split("\n")
            assert left[0] == head and left[2] == tail and set(copy.split()) - set(texts[i].split()) <= set(left[1].split())
    assert verdicts == {True, False}


def test_kept_copies_have_their_pieces(spark):
    """A passage is not taken for a copy of one that goes with its line."""
    r = random.Random(4)
    w = words(200, r)
    passage = " ".join(w[:20]) + "."
    first = " ".join([*words(1, r), *w[1:19], w[19] + ".", *w[20:]])
    line = " ".join([passage, *w[20:]])
    got = kept(spark, [first.replace(w[10], "other"), line, " ".join(words(40, r)) + ". " + passage])
    assert got[1] == "" and got[2].endswith(passage)
