"""The keyed index: upserts, deletes, hold-outs and versions; commits that die, or are overtaken."""

import json
import random

import pytest
from pyspark.sql import types as T

from lanternfish.operators import knn
from lanternfish.pipeline import Pipeline, Settings
from lanternfish.sources import index as I
from lanternfish.sources import snapshots
from tests import fakes

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("image_id", T.LongType()), T.StructField("document", T.StringType())])


def rows(spark, got):
    return spark.createDataFrame([(i, n, d) for i, (n, d) in got.items()], SCHEMA)


def held(snapshot):
    got = [tuple(r) for r in snapshot.read().collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


@pytest.mark.parametrize("sent", [0, 1000])
def test_against_a_dictionary(spark, tmp_path, monkeypatch, sent):
    """A run of commits leaves what a dictionary would hold, in every version, however delete vectors are joined."""
    monkeypatch.setattr(snapshots, "SENT", sent)
    t, now, kept, rng = snapshots.Table(spark, f"file://{tmp_path}/t", SCHEMA), {}, [{}], random.Random(3)
    for step in range(7):
        if step == 4:
            ids = ["3", "5", "nowhere"]
            now = {i: r for i, r in now.items() if i not in ids}
            t.delete(spark.createDataFrame([(i,) for i in ids], "id string"))
        else:
            new = {str(i): (i % 4, f"{step} {i}") for i in rng.sample(range(12), 6)}
            now = now | new
            assert t.upsert(rows(spark, new)) == step + 1
        kept.append(now)
    assert t.versions() == list(range(8))
    assert [held(t.snapshot(v)) for v in range(8)] == kept
    view = t.hold_out("quiz", spark.createDataFrame([(1,), (1,), (None,), (77,)], "image_id long"))
    assert held(view) == {i: r for i, r in now.items() if r[0] != 1} and held(t.snapshot()) == now
    with pytest.raises(FileExistsError):
        t.hold_out("quiz", view.read())
    assert t.compact() == 8 and held(t.snapshot()) == now and not t.snapshot().manifest.dead
    t.vacuum()
    assert held(t.snapshot()) == now and held(t.snapshot(view="quiz")) == held(view) and t.versions() == [8]
    with pytest.raises(LookupError):
        t.snapshot(3)
    t.delete(rows(spark, now))
    assert held(t.snapshot()) == {} and t.snapshot().manifest.batches == []


def test_twice_and_repeats(spark, tmp_path):
    """The same rows twice are one row an id, and the first folder isn't read again; repeated ids and null ids in one batch."""
    t = snapshots.Table(spark, f"{tmp_path}/t", SCHEMA)
    same = {str(i): (i, "x") for i in range(50)}
    t.upsert(rows(spark, same))
    t.upsert(rows(spark, same))
    m = t.snapshot().manifest
    assert held(t.snapshot()) == same and len(m.batches) == 1 and m.dead == [] and m.batches[0]["since"] == 2
    t.upsert(spark.createDataFrame([("1", 9, "b"), ("1", 8, "c"), (None, 1, "n"), ("60", None, None)], SCHEMA))
    assert held(t.snapshot()) == same | {"1": (8, "c"), "60": (None, None)}
    assert t.upsert(rows(spark, {})) == 4 and t.snapshot().count() == 51


def test_a_commit_that_dies(spark, tmp_path, monkeypatch):
    """Files without a manifest, or with a torn one, are not part of any version, and the next commit goes past them."""
    t, first = snapshots.Table(spark, f"{tmp_path}/t", SCHEMA), {"a": (1, "x")}
    t.upsert(rows(spark, first))
    with monkeypatch.context() as m:
        m.setattr(snapshots.Table, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.upsert(rows(spark, {"a": (2, "lost"), "b": (3, "lost")}))
    assert held(t.snapshot()) == first
    (tmp_path / "t/manifests/000000000002.json").write_text('{"version": 2, "batches": [')
    assert t.versions() == [0, 1] and held(t.snapshot()) == first
    monkeypatch.setattr(snapshots, "GRACE", -1.0)
    assert t.upsert(rows(spark, {"b": (4, "y")})) == 3
    assert held(t.snapshot()) == first | {"b": (4, "y")}
    gone = t.vacuum(keep=5)
    assert sum(g.startswith("data/") for g in gone) == 1 and held(t.snapshot(1)) == first


def test_commits_that_are_overtaken(spark, tmp_path, monkeypatch):
    """Two commits that start from one version are both there, and what the later one replaces is found anew."""
    path = f"{tmp_path}/t"
    t = snapshots.Table(spark, path, SCHEMA)
    t.upsert(rows(spark, {"a": (1, "old"), "b": (1, "old")}))
    publish, once = snapshots.Table._publish, []

    def overtaken(self, m):
        if not once:
            once.append(1)
            snapshots.Table(spark, path, SCHEMA).upsert(rows(spark, {"a": (2, "other"), "c": (2, "other")}))
        return publish(self, m)

    monkeypatch.setattr(snapshots.Table, "_publish", overtaken)
    assert t.upsert(rows(spark, {"a": (3, "mine"), "d": (3, "mine")})) == 3
    assert held(t.snapshot()) == {"a": (3, "mine"), "b": (1, "old"), "c": (2, "other"), "d": (3, "mine")}
    monkeypatch.setattr(snapshots.Table, "_publish", lambda *_: False)
    with pytest.raises(snapshots.Conflict):
        t.delete(rows(spark, {"a": (0, "")}))


def test_a_search_reads_one_snapshot(spark, tmp_path):
    """What is committed while a search is planned isn't in it, and the ranks of an index that was built twice are unique."""
    path = f"{tmp_path}/index"
    build = lambda say: I.upsert(spark.createDataFrame([(f"{i}_{i}", i, i, [1.0, float(i)], f"{say} {i}") for i in range(6)], I.SCHEMA), path)
    build("first")
    index = I.open_or_create(spark, path)
    found = knn.nearest_captions(spark.createDataFrame([(0, [1.0, 5.0])], "query_id long, embedding array<float>"), index, 3)
    build("second")
    got = lambda df: [(r["rank"], r["document"]) for r in df.orderBy("rank").collect()]
    assert got(found) == [(1, "first 5"), (2, "first 4"), (3, "first 3")]
    again = knn.nearest_captions(spark.createDataFrame([(0, [1.0, 5.0])], "query_id long, embedding array<float>"), I.open_or_create(spark, path), 3)
    assert got(again) == [(1, "second 5"), (2, "second 4"), (3, "second 3")]


def test_building_twice(spark, tmp_path):
    images = tmp_path / "images"
    images.mkdir()
    (images / "1.jpg").write_bytes(b"\x02\x04")
    (images / "2.jpg").write_bytes(b"\x01\x03")
    (tmp_path / "notes.json").write_text(json.dumps({"annotations": [{"image_id": 1, "id": 5, "caption": "even"}, {"image_id": 2, "id": 6, "caption": "odd"}]}))
    pipeline = Pipeline(spark, Settings(images=str(images), annotations=str(tmp_path / "notes.json"), index=str(tmp_path / "index")), fakes.encoder)
    assert pipeline.build_index() and pipeline.build_index()
    assert pipeline.setup().first()["total_embeddings"] == 2
    assert sorted(r.id for r in I.open_or_create(spark, str(tmp_path / "index")).collect()) == ["1_5", "2_6"]
