"""Every operator and every stage on odd rows: repeated ones, ids that clash or are missing, long texts, names that clash, no rows."""

import random

import corpus_pipeline
import pytest
from small_texts import prose

from quarry.llm import decontaminate, jaccard, language, packing, pages, paragraphs, pii, quality, secrets, substrings

CLASHING = "row at a b c entry n low high class cluster doc lead place part kind secrets candidates spans loose codes holders line runs items piece key zone scan weight node component".split()


def thue_morse(k, one, other):
    x = [0]
    for _ in range(k):
        x += [1 - y for y in x]
    return "".join(other if y else one for y in x)


R = random.Random(17)
WHOLE, OTHER = prose(80, R), prose(90, R)
LONG = " ".join(f"long{i}" for i in range(60_000))
ROWS = [
    (1, WHOLE), (1, WHOLE),  # repeated
    (2, OTHER), (2, prose(70, R)),  # one id, two texts
    (None, WHOLE), (None, prose(60, R)), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, LONG), (7, WHOLE + " more"),
    (8, thue_morse(11, "a", "b")), (9, thue_morse(11, "b", "a")),  # unlike words that weak hashes take for one
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i and i % 2 else None, f"s{i}" if i else None, len(t or ""), *([-1] * len(CLASHING))) for i, t in ROWS]
    names = ", ".join(f"{c} int" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {names}").repartition(3).cache()


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


ALL = sorted((i for i, _ in ROWS), key=str)


def test_personal_data_and_secrets(spark, odd):
    assert ids(pii.spans(spark, odd)) == ALL
    out = secrets.found(spark, odd)
    assert ids(out) == ALL and set(out.columns) == set(odd.columns)


def test_repeats_of_bytes(spark, odd):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"] > 0) for r in substrings.remove_repeats(spark, odd).collect()), key=str)
    gone = {WHOLE, WHOLE + " more"}
    assert got == sorted(((i, len((t or "").encode()), t in gone or i in (8, 9)) for i, t in ROWS), key=str)


def test_quality(spark, odd):
    got = quality.rated(spark, odd).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == ALL
    assert [r["kept"] for r in got if r["doc_id"] == 1] == [True, True] and sum(r["n_words"] for r in got if r["doc_id"] == 6) == 60_000


def test_unlike_lines_have_unlike_hashes(spark):
    import pyarrow as pa

    m = quality.measure(pa.array([ROWS[-1][1], ROWS[-2][1]]))
    assert m["line"][0] != m["line"][1]


def test_language(spark, odd):
    names, table = language.train(odd)
    assert ids(language.identify(odd, names, table)) == ALL
    assert names == ["en"] and language.train(odd.limit(0))[0] == []


def test_similar(spark, odd):
    got = jaccard.similar(spark, odd).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == ALL
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[1] == [(78, 1), (78, 1)] and by[7] == [(79, 1)]
    assert sorted(n for n, _ in by[2]) == [68, 88] and {c for _, c in by[2]} == {2}
    assert (78, 1) in by[None] and by[3] == by[4][:0] + [(0, 3)] and by[8] == [(1, 8)] and by[9] == [(1, 9)] and by[6] == [(59_998, 6)]


def test_paragraphs(spark, odd):
    got = paragraphs.without_repeats(spark, odd).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == ALL
    one = sorted((r["n_removed"], r["kept_text"]) for r in got if r["doc_id"] == 1)
    assert one == [(0, WHOLE), (1, "")]  # repeated rows are documents of their own: the first keeps its text
    assert sorted(r["kept_text"] for r in got if r["doc_id"] == 2) == sorted(t for i, t in ROWS if i == 2)
    assert sorted(r["kept_text"] for r in got if r["doc_id"] is None) == sorted(t or "" for i, t in ROWS if i is None)  # no id: all is kept
    assert {r["doc_id"]: r["kept_text"] for r in got if r["doc_id"] in (6, 8, 9)} == {i: t for i, t in ROWS if i in (6, 8, 9)}
    assert [r["n_removed"] for r in got if r["doc_id"] == 7] == [1] and [r["first_ids"] for r in got if r["doc_id"] == 7] == [[1]]


def test_packing(spark, odd):
    got = packing.pack(spark, odd, packing.tokenizer_path()).toPandas()
    whole = got[got["start"] == 0]
    assert len(whole) == len(ROWS) and got["length"].max() <= 4096


def test_leaks(spark, odd):
    bench = spark.createDataFrame([(1, WHOLE, 5), (1, WHOLE, 5), (None, None, 5)], "item_id bigint, text string, row int")
    results = []
    for block in (10**6, 50):
        got = decontaminate.overlap(spark, odd, bench, block_bytes=block).collect()
        results.append(sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str))
    assert results[0] == results[1] and [x[0] for x in results[0]] == ALL
    assert sum(n > 0 for _, _, n, _ in results[0]) == 4


def test_recall_of_paragraph_bands():
    """Pairs of random sets with a similarity of 0.8 to 0.85 collide in one band at least as often as is promised."""
    import numpy as np

    rng = np.random.default_rng(6)
    hit = 0
    for _ in range(3000):
        n = int(rng.integers(9, 120))
        common = rng.integers(0, 2**63, n, dtype=np.uint64)
        left, right = (rng.integers(0, 2**63, n // 9, dtype=np.uint64) for _ in range(2))
        bands = [[min(int(x) for x in paragraphs.K.mix(np.concatenate([common, own]) ^ seed)) for seed in paragraphs._SEEDS] for own in (left, right)]
        hit += any(x == y for x, y in zip(*bands, strict=True))
    assert hit / 3000 >= paragraphs.RECALL - 0.01 >= 0.9


def test_stages(spark, odd, tmp_path):
    spark.createDataFrame([(1, OTHER)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for empty in (False, True):
        now = odd.limit(0) if empty else odd
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, str(tmp_path))
            assert out.dtypes == odd.dtypes
            now = spark.createDataFrame(out.collect(), odd.schema)
            kept[name, empty] = sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=str)
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert (packed.count() == 0) == empty
    assert not any(rows for (_, empty), rows in kept.items() if empty)
    good = [(i, t) for i, t in ROWS if t and len(t.split()) >= 50]
    assert kept["quality_rules", False] == sorted(good, key=str)
    # of the five like WHOLE one stays, with an id or without
    near = kept["near_duplicates", False]
    assert sum(t in (WHOLE, WHOLE + " more") for _, t in near) == 1 and {t for _, t in near} >= {t for _, t in good} - {WHOLE, WHOLE + " more"}
    assert {t for _, t in kept["decontamination", False]} == {t for i, t in near if i != 2}  # rows of one id go together


def test_very_long_and_empty_pages(spark):
    df = spark.createDataFrame([(1, "u", "<article>" + "<p>Some words of it.</p>" * 20_000, 3)], "page_id bigint, url string, html string, text int")
    assert pages.extract(df).first()["n_chars"] == 20_000 * 18 - 1
    assert pages.extract(df.limit(0)).count() == 0


def test_the_limit_of_a_large_host_is_bounded(spark, monkeypatch):
    line = prose(30, R)
    rows = [(i, prose(60, R) + ("\n" + line if i < 40 else ""), "h") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    monkeypatch.setattr(quality, "LEAST_PART", 0.5)
    assert quality.rated(spark, df).where("removed_words > 0").count() == 0
    monkeypatch.setattr(quality, "MOST_DOCS", 35)
    assert quality.rated(spark, df).where("removed_words = 30").count() == 40
