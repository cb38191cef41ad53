"""Every operator on empty tables, repeated rows, nulls in any column, and columns that are called like its own."""

import pytest
from pyspark.sql import functions as F

from lanternfish.llm import chat, decontaminate, exact_dedup, licences, quality, queries, secrets, sentencepiece_bpe, simhash, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "alpha beta gamma delta " * 20_000
ROWS = [(1, "one two three", "en", "s", 13), (1, "one two three", "en", "s", 13), (2, None, None, None, None), (3, "", "en", None, 0), (None, "one two three", None, "s", 13), (None, None, None, None, None), (4, LONG, "en", "s", len(LONG))]
#: What operators call their results and their own columns.
NAMES = ["keep_id", "Kept", "score", "spans", "fingerprint", "component_id", "n_words", "__id", "__key", "__chars", "__text", "__h", "__block", "__bits", "__maybe", "__fp", "__known", "__salt", "__size", "__best", "__y", "__lang", "item_id", "toxic", "first", "fp"]


def with_names(df):
    return df.select("*", *[F.lit("x").alias(n) for n in NAMES])


def labels(spark):
    return with_names(spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None), (3, 0, 1), (3, 0, 0)], "doc_id bigint, quality int, label_toxic int")).drop("toxic").withColumnRenamed("label_toxic", "toxic")


def bench(spark):
    return spark.createDataFrame([(7, "two three"), (7, "two three"), (None, None), (8, "")], "item_id bigint, text string").withColumn("__id", F.lit(0)).withColumn("doc_id", F.lit(5))


OPERATORS = {
    "decontamination": lambda s, d: decontaminate.contamination(d, bench(s)),
    "quality": lambda s, d: quality.quality(d, labels(s)),
    "sentencepiece": lambda s, d: sentencepiece_bpe.token_digests(d, queries.model_path()),
    "exact_dedup": lambda s, d: exact_dedup.exact_dedup(d),
    "exact_dedup_narrow": lambda s, d: exact_dedup.exact_dedup(d, carry=False),
    "simhash": lambda s, d: simhash.near_dedup(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "secrets": lambda s, d: secrets.secret_spans(d),
    "licences": lambda s, d: licences.licence_spans(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    run = OPERATORS[name]
    plain = spark.createDataFrame(ROWS, DOCS)
    got, odd = run(spark, plain), run(spark, with_names(plain))
    assert got.count() == len(ROWS)
    results = [c for c in got.columns if c not in plain.columns or c == "doc_id"]
    key = lambda r: str(r)
    want = sorted((r for r in got.select(results).collect()), key=key)
    assert sorted(odd.select(results).collect(), key=key) == want
    twice = [r for r in want if r.doc_id == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert sum(r.doc_id is None for r in want) == 2
    empty = run(spark, with_names(plain).where("false"))
    assert empty.count() == 0 and set(results) <= set(empty.columns)


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "simhash", "decontamination"])
def test_filters_keep_the_columns(spark, name):
    import corpus_pipeline

    stage = {"toxicity": lambda d: toxicity.drop_toxic(d, labels(spark)), "exact_dedup": lambda d: corpus_pipeline.without_copies(spark, d, None), "simhash": simhash.keep_first,
             "decontamination": lambda d: decontaminate.drop_contaminated(d, bench(spark))}[name]
    df = with_names(spark.createDataFrame(ROWS, DOCS))
    kept = stage(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {"toxicity": len(ids) <= 7, "exact_dedup": sorted(ids, key=str) == sorted([None, None, 4], key=str), "simhash": 4 in ids and ids.count(None) == 2, "decontamination": sorted(ids, key=str) == sorted([2, 3, None, 4], key=str)}[name]
    assert stage(df.where("false")).count() == 0


def test_pages_and_conversations(spark):
    pages = spark.createDataFrame([(1, "u", "h"), (2, None, "h"), (3, "u", None), (4, "u", "x" * 500_000)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in warc.warc_digests(with_names(pages)).collect()}
    assert {i: r.record_type for i, r in got.items()} == {1: "revisit", 2: "response", 3: "response", 4: "response"} and got[1].refers_to == 2
    assert warc.warc_digests(with_names(pages).where("false")).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, None, None, None), (None, 0, "user", "q")], "conv_id bigint, turn bigint, role string, text string")
    got = chat.swapped_replies(with_names(turns).withColumn("chosen", F.lit(1)).withColumn("turns", F.lit(2)).withColumn("reply", F.lit(3)))
    assert {r.conv_id for r in got.collect()} == {None, 1, 2}
