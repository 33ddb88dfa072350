import random

import corpus_pipeline
from test_near_paragraphs import words


def test_near_copies_just_above_the_limit_go(spark, tmp_path):
    r = random.Random(8)
    texts = []
    for n, edits in ((100, (30, 60)), (200, (40, 80, 120, 160)), (100, (20, 40, 60))):  # five-word similarity 0.81, 0.815, 0.73
        w = words(n, r)
        texts += [" ".join(w), " ".join("edited%d" % i if i in edits else x for i, x in enumerate(w))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [0, 2, 4, 5]
