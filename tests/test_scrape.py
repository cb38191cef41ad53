"""A scrape that is interrupted, failures as rows with a cause, and listings as a stream."""

import pytest
from pyspark.sql import functions as F

from lanternfish.sources import remote
from lanternfish.streaming import scrape as module
from lanternfish.streaming.scrape import Scrape
from tests import fakes

SERVICE = "tests.fakes:Service"


def listed(s):
    return sorted((r.category, r.title, r.level, r.pos) for r in s.listed.snapshot().read().collect())


def said(s):
    return sorted((r.title, r.url, r.failure) for r in s.said.snapshot().read().collect())


def test_a_run_that_is_interrupted_twice(spark, tmp_path, monkeypatch):
    whole = Scrape(spark, SERVICE, f"{tmp_path}/whole")
    whole.run(["A", "Empty"], 3)
    want = sorted((r.category, r.title, r.level, r.pos) for r in remote.read_categories(spark, SERVICE, ["A", "Empty"], 3).collect())
    assert listed(whole) == want and [t for t, *_ in said(whole)] == ["1", "2", "3", "s1", "s2"]
    broken, take, times = Scrape(spark, SERVICE, f"{tmp_path}/broken"), Scrape._take, []

    def dies(self, batch, number):
        times.append(number)
        if len(times) == 2:
            raise OSError("before anything is kept")
        if len(times) == 4:
            self.said.upsert(remote.outcomes(batch.select("title"), self.client))
            raise OSError("between the two tables")
        take(self, batch, number)

    monkeypatch.setattr(module.Scrape, "_take", dies)
    for _ in range(2):
        with pytest.raises(Exception, match="before anything|between the two|foreachBatch|FOREACH"):
            broken.run(["A", "Empty"], 3)
    broken.run(["A", "Empty"], 3)
    assert len(times) > len(set(times)) and listed(broken) == want and said(broken) == said(whole)
    before = broken.said.versions()
    broken.run(["A", "Empty"], 3)  # nothing is left to list
    assert broken.said.versions() == before
    phrases = spark.createDataFrame([("A", "a"), ("Empty", "e")], "category string, phrase string")
    got = [s.taken(phrases, 100, 10)[1].orderBy("image_id").collect() for s in (whole, broken)]
    assert got[0] == got[1]


def test_failures_are_rows(spark, tmp_path, monkeypatch):
    titles = spark.createDataFrame([(t,) for t in ("bad", "1", "2", "unknown", None)], "title string").coalesce(1)
    got = {r.title: r.failure for r in remote.outcomes(titles, SERVICE, 2).collect()}
    assert got == {"bad": "ValueError: refused", "1": "ValueError: refused", "2": None, "unknown": "unknown"}
    assert {r.failure: r.n for r in remote.failures(remote.outcomes(titles, SERVICE, 2)).collect()} == {"ValueError: refused": 2, "unknown": 1}
    found = spark.createDataFrame([("1", "u/1", "t/1"), ("3", "u/3", None), ("4", None, "")], "title string, url string, thumb_url string")
    assert {r.title: (r.content and bytes(r.content), r.failure) for r in remote.fetched(found, SERVICE).collect()} == {"1": (b"t/1", None), "3": (None, "ValueError: gone"), "4": (None, "no url")}
    s = Scrape(spark, SERVICE, f"{tmp_path}/s")
    s._take(spark.createDataFrame([("A", "bad", 0, 0), ("A", "1", 0, 1), ("B", "1", 0, 0)], "category string, title string, level int, pos int").coalesce(1))
    assert {r.failure: r.n for r in s.failures().collect()} == {"ValueError: refused": 2}
    s.said.delete(spark.createDataFrame([("bad",)], "title string"))
    assert s.retry() == 0 and said(s) == [("1", "u/1", None)] and len(listed(s)) == 3


def test_offsets():
    """A page at a time, and the same again between two offsets."""
    reader = remote._Pages({"client": SERVICE, "most": "3", "categories": '["A", "Empty"]'})
    at, rows, steps = reader.initialOffset(), [], [reader.initialOffset()]
    while True:
        part, then = reader.read(at)
        rows += part
        if then == at:
            break
        at = then
        steps.append(at)
    assert [(c, t) for c, t, *_ in rows] == [("A", "1"), ("A", "2"), ("A", "3"), ("Empty", "s1"), ("Empty", "1"), ("Empty", "s2")]
    assert [r for a, b in zip(steps, steps[1:]) for r in reader.readBetweenOffsets(a, b)] == rows == list(reader.readBetweenOffsets(steps[0], steps[-1]))
    assert fakes.Service().page("A", "file", None)[1] == 1
