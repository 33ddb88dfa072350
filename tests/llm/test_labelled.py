"""Operators that SQL can't express, on labelled corpora: measured precision, recall and accuracy."""

import os
import random
import zlib

import pytest

from quarry.llm import language, pii

SF = "/root/testdata/sf0.01"


def personal(r):
    """(text, spans of personal data in forms that the base patterns miss) by rule."""
    digit = lambda n: "".join(r.choices("0123456789", k=n))
    word = lambda: "".join(r.choices("abcdefghilmnoprstu", k=r.randint(3, 8)))
    area = f"{r.randint(2, 9)}{r.randint(0, 8)}{r.randint(0, 9)}"
    real = [
        ("Write to", f"{word()}.{word()} [at] {word()} [dot] {r.choice(['com', 'org', 'net', 'de'])}"),
        ("my e-mail:", f"{word().upper()}(AT){word().upper()}(DOT)COM"),
        ("contact", f"{word()} {{at}} {word()}.{r.choice(['org', 'io', 'edu'])}"),
        ("Call", f"({area}) 555-{digit(4)}"),
        ("phone:", f"{area}-555-{digit(4)}"),
        ("mobile", f"{area}.{r.randint(200, 999)}.{digit(4)}"),
        ("server", ":".join("".join(r.choices("0123456789abcdef", k=4)) for _ in range(8))),
    ]
    harmless = [
        ("Order no.", f"0{digit(2)} {digit(3)} {digit(4)}"),
        ("part", f"1{digit(2)}.{digit(3)}.{digit(4)}"),
        ("build", f"0{digit(2)}-{digit(3)}-{digit(4)}"),
        ("serial", f"{digit(4)}:{digit(4)}"),
        ("meet", f"{word()} (at) {word()} square"),
        ("version", f"{digit(1)}.{digit(2)}.{digit(1)}"),
    ]
    strict = [("mail", f"{word()}@{word()}.com"), ("phone", f"+1 ({area}) 555-{digit(4)}"), ("from", f"10.{r.randint(0, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}")]
    text, spans = "", []
    for kind in r.sample(["real", "harmless", "strict", "plain", "plain"], 4):
        cue, value = r.choice({"real": real, "harmless": harmless, "strict": strict, "plain": [(word(), word())]}[kind])
        text += " ".join(word() for _ in range(r.randint(2, 9))) + f" {cue} "
        if kind == "real":
            spans.append((len(text), len(text) + len(value)))
        text += value + r.choice([". ", ", ", " "])
    return text, spans


def test_added_personal_data(spark):
    r = random.Random(21)
    rows = [personal(r) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {x["doc_id"]: {(s["start"], s["end"]) for s in x["added"]} for x in pii.spans(spark, df).collect()}
    wanted = sum(len(s) for _, s in rows)
    hit = sum(len(got[i] & set(s)) for i, (_, s) in enumerate(rows))
    said = sum(map(len, got.values()))
    assert hit / wanted >= 0.9 and hit / said >= 0.9, (hit, wanted, said)


def test_capitals_are_found_without_other_words(spark):
    rows = [(i, f"JO.SMITH{i} [AT] SITE [DOT] COM") for i in range(30)] + [(50 + i, f"WRITE JO{i}@SITE.COM") for i in range(30)]
    got = pii.spans(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).where("size(added) = 1 and doc_id < 50").count()
    assert got == 30


def test_classifier_does_not_depend_on_the_corpus_size():
    counts = {code: 1 + code % 7 for code in range(0, 4 * 3**5 * 16, 37)}
    _, belief = pii.reliabilities(counts)
    one, many = pii.classifier(counts, belief), pii.classifier({c: 10**6 * n for c, n in counts.items()}, belief)
    assert all(abs(one[c] - many[c]) < 1e-6 for c in counts)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_held_out_accuracy_of_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, table = language.train(docs)
    got = language.identify(docs, names, table).join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang is not null").collect()
    held = [x for x in got if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 and x["lang_pred"] != "und"]
    assert len(held) > 100 and sum(x["lang_pred"] == x["lang"] for x in held) / len(held) >= 0.97
    # scores are calibrated: their mean is about the accuracy
    assert abs(sum(x["score"] for x in held) / len(held) - sum(x["lang_pred"] == x["lang"] for x in held) / len(held)) < 0.1


def test_rare_languages_are_learned(spark):
    rows, r = [], random.Random(3)
    for k in range(230):  # more than any fixed number of languages
        letters = [chr(0x4E00 + 5 * k + j) for j in range(5)]
        rows += [(len(rows) + j, " ".join("".join(r.choices(letters, k=4)) for _ in range(8)), f"l{k:03}") for j in range(6)]
    only = [i for i in range(10**4, 10**4 + 60) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows += [(i, "".join(r.choices("кнтш", k=30)), "calibration") for i in only]  # no row of it may train but these
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    names, table = language.train(df)
    assert len(names) == 231
    got = {x["doc_id"]: x["lang_pred"] for x in language.identify(df, names, table).collect()}
    assert all(got[i] == "calibration" for i in only) and sum(got[i] == k for i, _, k in rows) / len(rows) > 0.9
