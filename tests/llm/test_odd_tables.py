"""Every operator and pipeline stage on nulls in every column, repeated rows, ties, long texts, clashing names and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isogrid.llm import fingerprints, mixing, ngram_join, packing, quality, secret_scan, sharding, token_binary, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "spam eggs " * 60_000
ROWS = [(1, "a plain text of some words", "en", "s1", 26), (1, "a plain text of some words", "en", "s1", 26), (2, None, None, None, None), (None, "no id", "en", "s2", 5), (3, "", "", "", 0), (4, LONG, "en", "s1", len(LONG)), (5, "a plain text of some words", None, "s2", None)]
CLASHING = ["row_id", "n", "ids", "size", "taken", "target", "slot", "shard", "score", "key", "block", "ahead", "label", "held_out", "kept", "component_id", "h1", "id", "part", "toxic", "verdict", "host", "term", "u", "v"]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ROWS, DOCS)
    return frame.select("*", *(F.lit("x" if k % 2 else k).alias(c) for k, c in enumerate(CLASHING)))


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, None, 1), (5, 1, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "join": lambda s, d: ngram_join.link_documents(d),
    "packing": lambda s, d: packing.pack(d),
    "mixing": lambda s, d: mixing.mix(d),
    "toxicity": lambda s, d: toxicity.score(d, labels(s)),
    "urls": lambda s, d: url_filter.filter_urls(d.withColumn("page_id", F.col("doc_id")).withColumn("url", F.col("text"))),
    "sharding": lambda s, d: sharding.place(d),
    "tokens": lambda s, d: token_binary.round_trip(d),
    "fingerprints": lambda s, d: fingerprints.fingerprints(d),
    "secrets": lambda s, d: secret_scan.scan_documents(d),
    "quality": lambda s, d: quality.assess(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_odd_rows_and_no_rows(spark, odd, name):
    rows = OPERATORS[name](spark, odd).collect()
    if name == "packing":
        assert len({(r["doc_id"], r["doc_tokens"]) for r in rows}) == len(ROWS) - 1 and sum(r["start"] == 0 for r in rows) == len(ROWS)
    else:
        assert len(rows) == len(ROWS)
    assert OPERATORS[name](spark, odd.where("false")).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows_and_no_rows(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, "")
    n = out.count()
    if name != "packing":
        assert out.columns == odd.columns
    assert n == {"quality_rules": 0, "near_duplicates": 5, "secrets": 7}.get(name, n) and n <= 3 * 7 + 400
    assert stage(spark, odd.where("false"), "").count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark, odd):
    kept = ngram_join.one_of_each_group(odd)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "None"]
