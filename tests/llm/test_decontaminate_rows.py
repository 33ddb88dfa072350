import pytest

from quarry.llm import decontaminate


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 40])
def test_one_result_a_row_and_items_without_id(spark, block_bytes):
    leak, other = " ".join(f"leak{i}" for i in range(12)), " ".join(f"other{i}" for i in range(12))
    rows = [(1, leak), (1, leak), (1, "clean text"), (None, leak), (None, "x " + other), (2, f"{leak} and {other}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([("a", leak), (None, other)], "item_id string, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.overlap(spark, docs, bench, block_bytes=block_bytes).collect()]
    assert sorted(got, key=repr) == sorted([(1, 12, 12, ("a",)), (1, 12, 12, ("a",)), (1, 2, 0, ()), (None, 12, 12, ("a",)), (None, 13, 12, (None,)), (2, 25, 24, ("a", None))], key=repr)
