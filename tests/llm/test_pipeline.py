"""The pipeline's stages, each on its own input, and the registered queries."""

import __spark_entry__
import corpus_pipeline
from isogrid.llm import mixing, ngram_join, quality, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mixing", "packing"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        if name == "quality_rules":
            want = {r["doc_id"] for r in quality.assess(docs).where("kept").collect()}
            assert {r["doc_id"] for r in out.collect()} == want and len(want) < before
        elif name == "near_duplicates":
            found = ngram_join.link_documents(docs, width=5, percent=80).collect()
            assert sorted(r["doc_id"] for r in out.collect()) == sorted({r["component_id"] for r in found})
        elif name == "secrets":
            assert out.count() == docs.count()
            assert not any(secret_scan.scan(r["text"]) for r in out.collect())
        else:
            assert out.count() >= mixing.mix(docs).where("taken > 0").count()
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_all_ten_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
