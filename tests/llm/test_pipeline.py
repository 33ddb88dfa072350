import corpus_pipeline
from small_texts import prose
from pyspark.sql import functions as F

import __spark_entry__


def test_stages(spark, docs, texts, tmp_path):
    long = [i for i in range(8, 30) if len(texts[i].split()) >= 60]
    leaked, clean = long[0], long[1]
    bench = " ".join(texts[leaked].split()[3:20])
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    secret = prose(90)
    now = docs.unionByName(docs.where("doc_id = 8").withColumn("text", F.lit("password=b7db7aa4a5fcc78305 " + secret)).withColumn("doc_id", F.lit(500).cast("long")))
    copies = [i for i in range(30, 36) if len(texts[0].split()) >= 50]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns and out.dtypes == now.dtypes
        now = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r["doc_id"]: r for r in now.collect()}
    assert not {60, 61, 63} & set(kept["quality_rules"]) and {leaked, clean, *copies} <= set(kept["quality_rules"])
    assert not set(copies) & set(kept["near_duplicates"]) and {leaked, clean} <= set(kept["near_duplicates"])
    assert leaked not in kept["decontamination"] and clean in kept["decontamination"]
    r = kept["secret_scans"][500]
    assert r["text"] == "password=[SECRET] " + secret and r["secrets"] == "x" and r["n_chars"] == len(r["text"])
    assert kept["secret_scans"][clean]["text"] == texts[clean]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(kept["secret_scans"])


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert not set(__spark_entry__.oracle_sql()) - set(names)
