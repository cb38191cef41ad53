"""Deduplication stages of tables whose ids repeat or are null: one row of each group stays."""

import pytest

from lanternfish.llm import exact_dedup, simhash

DOCS = "doc_id bigint, text string, lang string"
NEAR = " ".join(f"w{i}" for i in range(3000))


def left(stage, spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    return sorted(map(str, map(tuple, stage(df).collect())))


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    rows = [(1, NEAR, "en"), (2, NEAR + " x", "en"), (2, "a clean text of its own", "en"), (3, "another one", "en")]
    assert left(simhash.keep_first, spark, rows) == sorted(map(str, [rows[0], rows[2], rows[3]]))


@pytest.mark.parametrize("stage", [exact_dedup.keep_best, simhash.keep_first])
def test_repeated_rows(spark, stage):
    rows = [(1, "one text", "en")] * 3 + [(None, "other words here", "en")] * 2 + [(None, "still other words", None), (2, "still other words", "en"), (3, None, "en"), (3, "", "en"), (4, "alone", "en")]
    got = left(stage, spark, rows)
    assert [x for x in got if "(3" not in x] == sorted(map(str, [rows[0], rows[3], rows[5], rows[9]])) and len(got) == 5


def test_rows_that_differ_elsewhere(spark):
    rows = [(1, "one text", lang) for lang in ("en", "fr", "de", None)] * 5
    for stage in (exact_dedup.keep_best, simhash.keep_first):
        assert len(got := left(stage, spark, rows)) == 1 and got == left(stage, spark, rows[::-1])
