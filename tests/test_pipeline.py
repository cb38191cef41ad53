"""The engine as an object and a command, models and the remote service, with fakes in their places."""

import json

import pytest

from lanternfish.__main__ import main
from lanternfish.functions import models
from lanternfish.pipeline import Pipeline, Settings
from lanternfish.sources import remote
from tests import fakes

SERVICE = "tests.fakes:Service"


def test_retries():
    waits, left = [], [remote.Busy(), OSError(), remote.Busy()]

    def call():
        if left:
            raise left.pop(0)
        return 7

    assert remote.retried(call, longest=2, sleep=waits.append) == 7
    assert waits == [1, 2, 2]

    def busy():
        raise remote.Busy

    with pytest.raises(RuntimeError):
        remote.retried(busy, tries=5, longest=None, sleep=waits.append)
    assert waits[3:] == [1, 2, 4, 8, 16]
    with pytest.raises(OSError):
        remote.retried(lambda: open("/nowhere"), network=False, sleep=waits.append)


def test_remote(spark):
    got = remote.read_categories(spark, SERVICE, ["A", "Empty"], 3).orderBy("category", "pos").collect()
    assert [(r.category, r.title, r.level) for r in got] == [("A", "1", 0), ("A", "2", 0), ("A", "3", 0), ("Empty", "s1", 1), ("Empty", "1", 1), ("Empty", "s2", 1)]
    assert remote.read_categories(spark, SERVICE, ["A"], 2).count() == 2
    titles = spark.createDataFrame([(t,) for t in ("1", "2", "3", "unknown", None)], "title string").coalesce(1)
    info = remote.look_up(titles, SERVICE)
    assert sorted((r.title, r.width, r.height) for r in info.collect()) == [("1", 300, None), ("2", 300, None), ("3", 300, None)]
    assert sorted((r.title, bytes(r.content)) for r in remote.downloaded(info, SERVICE).collect()) == [("1", b"t/1"), ("2", b"u/2")]
    failing = spark.createDataFrame([(t,) for t in ("bad", "1", "2")], "title string").coalesce(1)
    assert [r.title for r in remote.look_up(failing, SERVICE, 2).collect()] == ["2"]


def test_models(spark):
    rows = spark.createDataFrame([(1, b"\x02\x04"), (2, b"\x01"), (3, None)], "image_id long, content binary")
    got = {r.image_id: r.embedding for r in models.encoded(rows, "content", fakes.encoder).collect()}
    assert got[1] == pytest.approx([1, 0]) and got[2] == pytest.approx([0, 1], abs=1e-5) and got[3] is None
    with pytest.raises(RuntimeError):
        models.encoded(rows, "content", None)
    assert sorted(tuple(r)[:6] for r in models.detections(rows, fakes.detector).collect()) == [(1, 1, 0.9, 0, 0, 2), (2, 1, 0.9, 0, 0, 1)]
    assert models.segment_pixels(rows, None, enabled=False).count() == 0
    with pytest.raises(RuntimeError):
        models.detections(rows)


def test_pipeline_and_command(spark, tmp_path, capsys):
    images = tmp_path / "images"
    images.mkdir()
    (images / "1.jpg").write_bytes(b"\x02\x04")
    (images / "2.jpg").write_bytes(b"\x01\x03")
    notes = tmp_path / "notes.json"
    notes.write_text(json.dumps({"annotations": [{"image_id": 1, "id": 5, "caption": "even"}, {"image_id": 2, "id": 6, "caption": "odd"}, {"image_id": 9, "id": 7, "caption": "no image"}]}))
    index = str(tmp_path / "index")
    settings = Settings(images=str(images), annotations=str(notes), index=index)
    assert not Pipeline(spark, Settings(images=str(tmp_path / "none"), annotations=str(notes), index=index), fakes.encoder).build_index()
    pipeline = Pipeline(spark, settings, fakes.encoder)
    assert pipeline.setup().first()["total_embeddings"] == 0
    assert pipeline.caption_image(str(images / "1.jpg"))["generated_caption"] == ""
    assert pipeline.build_index()
    assert pipeline.setup().first().asDict() == {"total_embeddings": 2, "collection_name": "index"}
    got = pipeline.caption_image(str(images / "2.jpg"), top_k=1, advanced=False)
    assert (got["generated_caption"], got["backend"]) == ("odd", "retrieval") and got["distance"] == pytest.approx(0, abs=1e-6)
    common = ["--images", str(images), "--annotations", str(notes), "--index", index, "--encoder", "tests.fakes:encoder"]
    assert main([*common, "caption", "--image", str(images / "1.jpg"), "--skip-crops"]) == 0
    assert "Backend: retrieval" in capsys.readouterr().out
    assert main([*common, "setup"]) == 0 and "2" in capsys.readouterr().out
    assert main(["--images", str(tmp_path / "none"), "--index", index, "build-db"]) == 1
