"""Ingest, reports, approximate search, timed retrieval, and metrics against plain versions."""

import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.operators import approximate, diagnostics, geometry, ingest, knn, metrics, near_text, quantize, retrieve, selection
from lanternfish.sources import index as I


def vectors(spark, m, key="image_id"):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(m)], f"{key} bigint, embedding array<float>")


def test_scraped(spark):
    listed = spark.createDataFrame([("b", "a bee", 1, "t1"), ("a", "an ant", 2, "t2"), ("a", "an ant", 1, "t3"), ("a", "an ant", 3, "Logo of x"), ("b", "a bee", 2, "t5"), ("b", "a bee", 3, "t6"), ("c", "a cow", 1, "t7")], "category string, phrase string, place int, title string")
    told = [("t1", "image/jpeg", 300, 300, "u1", "<b>A long  description here</b>"), ("t2", "image/png", 300, 300, "u2", None), ("t3", "image/jpeg", 300, 100, "u3", None), ("Logo of x", "image/jpeg", 300, 300, "u4", None),
            ("t5", "image/jpeg", 300, 300, "u2", "the same url again"), ("t6", "image/jpeg", 300, 300, "u6", "the coat of arms of x"), ("t7", "image/jpeg", 900, 900, "u7", None)]
    info = spark.createDataFrame([(*r, "me", "CC0", "l", "p") for r in told], "title string, mime string, width int, height int, url string, description string, artist string, licence string, licence_url string, page_url string")
    taken, notes = ingest.scraped(listed, info, ["category", "place"], 100, 10)
    assert sorted(map(tuple, taken.collect())) == [(100, 100, "A photograph of an ant."), (101, 101, "A long description here"), (102, 102, "A photograph of a bee."), (103, 103, "A photograph of a cow.")]
    assert [(r.title, r.author, r.category) for r in notes.orderBy("image_id").collect()] == [("t2", "me", "a"), ("t1", "me", "b"), ("t6", "me", "b"), ("t7", "me", "c")]
    came = spark.createDataFrame([("t1", b"x"), ("t6", None), ("t7", b"y")], "title string, content binary")
    taken, _ = ingest.scraped(listed, info, ["category", "place"], 100, 1, came)
    assert [tuple(r) for r in taken.collect()] == [(100, 100, "A long description here")]


def test_labelled_images(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"rice": "a plate of rice", "soup": "a bowl of soup", "other": "x"}))
    templates = I.read_templates(spark, f"file://{tmp_path}/t.json", ["soup", "rice"])
    shards = spark.createDataFrame([(1, 2, 0, b"a"), (0, 9, 1, b"b"), (1, 1, 1, b"c")], "shard int, pos int, label int, content binary")
    got = ingest.labelled_images(shards, templates, ["shard", "pos"]).orderBy("image_id").collect()
    assert [(r.image_id, r.id, r.caption, bytes(r.content)) for r in got] == [(90_000_000, 90_000_000, "a plate of rice", b"b"), (90_000_001, 90_000_001, "a plate of rice", b"c"), (90_000_002, 90_000_002, "a bowl of soup", b"a")]
    with pytest.raises(ValueError, match="bread"):
        I.read_templates(spark, f"file://{tmp_path}/t.json", ["rice", "bread"])


def test_reports(spark, tmp_path):
    out = {"base_records": [{"file": "000012.jpg", "top1_distance": 0.5, "top1_caption": "c", "mean_topk_distance": 0.75}], "aug_records": [{"file": "7.png", "top1_distance": 0.25}], "n": 2}
    (tmp_path / "r.json").write_text(json.dumps(out))
    got = I.read_results(spark, f"file://{tmp_path}/r.json", {"base": "base_records", "augmented": "aug_records"})
    assert sorted(map(tuple, got.collect())) == [("augmented", 7, 0.25, None, None), ("base", 12, 0.5, "c", 0.75)]
    I.write_nested(spark.createDataFrame([(1, "x")], "a int, b string"), f"file://{tmp_path}/n", total=spark.createDataFrame([(3,)], "n int"))
    assert [json.loads(x[0]) for x in spark.read.text(f"file://{tmp_path}/n").collect()] == [{"records": [{"a": 1, "b": "x"}], "total": {"n": 3}}]
    I.write_attributions(spark.createDataFrame([(1, None)], "image_id int, author string"), f"file://{tmp_path}/a")
    assert [json.loads(x[0]) for x in spark.read.text(f"file://{tmp_path}/a").collect()] == [{"image_id": 1, "author": None}]


def test_approximate_search(spark, monkeypatch):
    """All lists give the exact answer, a few of clustered images most of it; a hot list is several parts."""
    rng = np.random.default_rng(2)
    m = np.concatenate([rng.normal(size=8) * 3 + rng.normal(size=(60, 8)) for _ in range(12)] + [np.tile(rng.normal(size=8), (300, 1))]).astype(np.float32)
    images = vectors(spark, m).repartition(3)
    q = images.where("image_id % 50 = 0").withColumnRenamed("image_id", "query_id")
    exact = {(r.query_id, r["rank"]): r.image_id for r in knn.top_images(q, images, 10, True).collect()}
    monkeypatch.setattr(approximate, "HELD", 70)
    index = approximate.index_of(images, 12)
    assert index[0].count() == len(m)
    assert {(r.query_id, r["rank"]): r.image_id for r in approximate.search(q, index, 10, 12, True).collect()} == exact
    some = approximate.search(q, index, 10, 3, True)
    assert approximate.recall(some, knn.top_images(q, images, 10, True)).first().recall >= 0.9
    empty = approximate.index_of(images.where("false"), 4)
    assert approximate.search(q, empty, 10, 2).count() == 0 and approximate.search(q.where("false"), index, 10, 2).count() == 0


POOL = "query_id bigint, variant_no int, rank bigint, document string, distance double"


def test_medoid_by_vectors(spark):
    """Fixed vectors: the most central text wins, of equal ones the first place; against a plain version."""
    pool = spark.createDataFrame([(1, 0, 1, "far", 0.1), (1, 0, 2, "left", 0.2), (1, 1, 1, "middle", 0.3), (1, 1, 2, "right", 0.4), (2, 0, 1, "b", 0.0), (2, 0, 2, "a", 0.0), (3, 0, 1, "lone", 0.5)], POOL)
    v = {"far": [0.0, 0.0, -1.0], "left": [1.0, 0.2, 0.0], "middle": [2.0, 2.0, 0.0], "right": [0.2, 1.0, 0.0], "a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "lone": [1.0, 1.0, 1.0]}
    df = spark.createDataFrame(list(v.items()), "document string, embedding array<float>")
    got = {r.query_id: (r.caption, r.distance, r.mean_similarity) for r in selection.select_medoid(pool, df).collect()}
    u = {k: np.array(np.float32(x), dtype=float) / np.linalg.norm(np.float32(x).astype(float)) for k, x in v.items()}
    others = {d: np.mean([u[d] @ u[e] for e in ("far", "left", "middle", "right") if e != d]) for d in ("far", "left", "middle", "right")}
    assert got[1][0] == max(others, key=others.get) == "middle" and got[1][2] == pytest.approx(others["middle"], abs=1e-9)
    assert got[2][:2] == ("b", 0.0) and got[3] == ("lone", 0.5, 0.0)


def test_timed(spark):
    index = spark.createDataFrame([("1_1", 1, 1, [1.0, 0.0], "x y"), ("2_2", 2, 2, [0.0, 1.0], "z")], "id string, image_id bigint, ann_id bigint, embedding array<float>, document string")
    v = spark.createDataFrame([(5, 0, [1.0, 0.0]), (5, 1, [0.0, 1.0])], "query_id bigint, variant_no int, embedding array<float>")
    text = spark.createDataFrame([("x y", [0.6, 0.8]), ("z", [0.0, 1.0])], "document string, embedding array<float>")
    got, took = retrieve.timed(v, index, "top1", vectors=text)
    assert list(took) == ["variants", "search", "choose", "score"] and min(took.values()) > 0
    row = got.first()
    assert (row.caption, row.mode) == ("x y", "top1") and row.clip_score == pytest.approx(1.5, abs=1e-6)
    slow = retrieve.query_latency(v.where("variant_no = 0"), index, knn.images_of(index))
    assert slow.count() == 1 and slow.first().ms > 0


def test_probe_and_ties(spark):
    found = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "b", 1.0), (2, 1, "c", 0.0)], "query_id bigint, rank int, document string, distance double")
    assert sorted(map(tuple, diagnostics.probe(found).collect())) == [(1, 0.5, "a", 0.75), (2, 0.0, "c", 0.0)]
    ranked = spark.createDataFrame([(1, 3, 0.9, 1), (1, 8, 0.9, 2), (1, 9, 0.8, 3)], "query_id bigint, image_id bigint, cosine double, rank int")
    assert [tuple(r) for r in diagnostics.tie_ranks(ranked).collect()] == [(1, 2, 8)]


def test_half_precision_and_random_boxes(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(50, 8)).astype(np.float32)
    got = np.array([r.embedding for r in quantize.fp16_round_trip(vectors(spark, m)).orderBy("image_id").collect()])
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    assert (got == unit.astype(np.float32).astype(np.float16).astype(np.float32)).all()
    images = spark.range(200).select(F.col("id").alias("image_id"), (F.col("id") + 1).cast("int").alias("width"), F.lit(480).alias("height"))
    boxes = geometry.random_boxes(images, 3).collect()
    for b in boxes:
        w, h = b.image_id + 1, 480
        assert 0 <= b.x0 <= b.x1 <= w and 0 <= b.y0 < b.y1 <= h and int(0.4 * w) <= b.x1 - b.x0 <= 0.8 * w and 192 <= b.y1 - b.y0 <= 384
    assert len(boxes) == 600 and len({(b.x0, b.y0, b.x1, b.y1) for b in boxes if b.image_id > 150}) > 100


def plain_lcs(a, b):
    return 0 if not a or not b else plain_lcs(a[1:], b[1:]) + 1 if a[0] == b[0] else max(plain_lcs(a[1:], b), plain_lcs(a, b[1:]))


def test_longest_common_words():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = (list(rng.choice(list("abc"), int(rng.integers(0, 7)))) for _ in range(2))
        assert metrics.lcs(a, b) == plain_lcs(a, b)


def test_scores_of_many_references(spark):
    """An item of very many references is scored in parts; the greatest of each part is the greatest of all."""
    c = spark.createDataFrame([(1, "a b c d"), (2, "x"), (3, "no reference")], "item int, candidate string")
    refs = [(1, "a b") for _ in range(300)] + [(1, "a q b r c s d")] + [(1, "z z")] * 50 + [(2, ""), (2, None)]
    ref = spark.createDataFrame(refs, "item int, reference string").repartition(4)
    words = lambda t: (t or "").split()
    for name, score in (("rouge_l", metrics.rouge_l_of), ("meteor_exact", metrics.meteor_exact_of)):
        got = {r.item: r[name] for r in getattr(metrics, name)(c, ref).collect()}
        want = {i: score(words(t), [words(x) for j, x in refs if j == i]) for i, t in ((1, "a b c d"), (2, "x"))}
        assert got == pytest.approx(want)


def test_scores_of_long_texts():
    """Twenty thousand words a side, against plain forms on what those can do."""
    rng = np.random.default_rng(6)
    for size in (0, 1, 7, 60):
        a, b = (list(rng.choice(list("abcdefgh"), size)) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next_row(row, x, b)
        assert metrics.lcs(a, b) == row[-1]
    long = [f"w{i % 7001}" for i in range(20_000)]
    assert metrics.lcs(long, long) == 20_000 and metrics.lcs(long, long[:5000]) == 5000
    assert metrics.meteor_exact_of(long, [long]) == pytest.approx(1 - 0.5 / 20_000**3)


def _next_row(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
    return new


def test_near_texts_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 30)))) for _ in range(60)]
    texts += [t + " w1" for t in texts[:20]] + [" ".join(reversed(t.split())) for t in texts[:10]] + [None, "", " .,", "same", "same same", "Same!"] + ["copy of a text"] * 30
    got = {r.doc_id: r[1:] for r in near_text.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    bags = [Counter(re.findall(r"\w+", (t or "").lower())) for t in texts]
    near = lambda x, y: bool(x and y) and round(sum(n * y[w] for w, n in x.items()) / np.sqrt(float(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))), 9) >= 0.95
    linked = [[j for j in range(len(texts)) if j != i and near(bags[i], bags[j])] for i in range(len(texts))]
    root = list(range(len(texts)))
    while (new := [min([root[i], *(root[j] for j in linked[i])]) for i in range(len(texts))]) != root:
        root = new
    for i in range(len(texts)):
        least = next(j for j in range(len(texts)) if bags[j] == bags[i]) if bags[i] else i
        assert got[i] == (least, root[i], len(linked[i]))


def test_near_texts_shuffle_less_than_four_times_their_text(spark):
    """Words follow few frequencies, so bounds prune little: what goes to other blocks is to be few and short rows."""
    rng = np.random.default_rng(9)
    share = 1 / np.arange(1, 3001)
    texts = [" ".join(f"word{i}" for i in rng.choice(3000, 80, p=share / share.sum())) for _ in range(5000)]
    texts += [f"{t} word1" for t in texts[:50]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sent = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000), spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite())[1]
    before = sent()
    near = near_text.near_texts(docs).where("links > 0").count()
    assert near >= 100 and 0 < sent() - before < 4 * sum(map(len, texts))


def test_near_texts_in_several_blocks(spark, monkeypatch):
    """Any number of blocks, and of words with numbers, and counts of any width find the same links and values."""
    rng = np.random.default_rng(10)
    share = 1 / np.arange(1, 61)
    texts = [" ".join(f"w{i}" for i in rng.choice(60, int(rng.integers(1, 200)), p=share / share.sum())) for _ in range(300)] + ["often " * n for n in (1, 300, 70_000)] + ["often " * 70_000 + "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bags = [Counter(t.split()) for t in texts]
    cosine = lambda x, y: round(sum(n * y[w] for w, n in x.items()) / np.sqrt(float(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))), 9)
    want = {(i, j): c for i in range(len(texts)) for j in range(i + 1, len(texts)) if (c := cosine(bags[i], bags[j])) >= 0.95 and bags[i] != bags[j]}
    assert len(want) > 100
    for side, numbers in ((1 << 16, 1 << 16), (20, 16), (50, 0)):
        monkeypatch.setattr(near_text, "NUMBERS", numbers)
        got = {(r.a, r.b): r.cosine for r in near_text.similar_texts(docs, side=side).collect()}
        assert {k: c for k, c in got.items() if bags[k[0]] != bags[k[1]]} == want
        links = {r.doc_id: r.links for r in near_text.near_texts(docs, side=side).collect()}
        assert all(links[i] == sum(j != i and (bags[i] == bags[j] or cosine(bags[i], bags[j]) >= 0.95) for j in range(len(texts))) for i in range(0, len(texts), 7))


def test_search_latency(spark):
    """Every query is timed by every task that holds vectors, in rounds or at once."""
    images = spark.range(400).select(F.col("id").alias("image_id"), F.array(*[F.rand(i).cast("float") for i in range(8)]).alias("embedding")).repartition(3)
    queries = images.where("image_id < 12").withColumnRenamed("image_id", "query_id")
    for size in (1 << 20, 3 * 64):
        got = retrieve.search_latency(queries, images, 5, size).collect()
        assert sorted(r.query_id for r in got) == list(range(12)) and all(0 < r.ms <= r.work_ms and r.tasks == 3 for r in got)
    assert retrieve.search_latency(queries.where("false"), images).count() == 0


def test_ties_that_go_the_other_way(spark):
    rows = [(1, 5, 1, 0.2), (1, 5, 2, 0.2), (1, 6, 1, 0.2 + 1e-12), (1, 7, 1, 0.3), (2, 5, 1, 0.1), (2, 6, 1, 0.4), (3, 9, 4, 0.0), (3, 9, 5, 0.0)]
    got = diagnostics.chain_disagreement(spark.createDataFrame(rows, "query_id long, image_id long, ann_id long, distance double")).first()
    assert tuple(got) == (3, 2, 2 / 3, 2)
    assert tuple(diagnostics.chain_disagreement(spark.createDataFrame([], "query_id long, image_id long, ann_id long, distance double")).first()) == (0, 0, None, 0)


def test_several_sources_in_one_run(spark):
    rows = [("base", 0.2), ("base", 0.4), ("x", 0.6), ("y", 0.3), ("y", None)]
    got = {r.source: (round(r["mean"], 9), r.n, round(r.shift_pct, 6)) for r in diagnostics.source_shift(spark.createDataFrame(rows, "source string, top1_distance double"), "base").collect()}
    assert got == {"base": (0.3, 2, 0.0), "x": (0.6, 1, 100.0), "y": (0.3, 1, 0.0)}
    assert all(r.shift_pct is None for r in diagnostics.source_shift(spark.createDataFrame(rows, "source string, top1_distance double"), "none").collect())


def test_generation_with_and_without_a_prompt(spark):
    model = F.pandas_udf(lambda context, prompt: prompt + " a picture", "string")
    got = {r.query_id: r for r in retrieve.generation_probe(spark.createDataFrame([(1, "A cat. More."), (2, "")], "query_id long, caption string"), model).collect()}
    assert got[1].prompted == "a photo related to: A cat a picture" and got[1].bare == " a picture" and got[1].echoed and not got[2].echoed


def test_urls_of_an_earlier_run(spark):
    listed = spark.createDataFrame([("c", "p", i, f"t{i}") for i in range(4)], "category string, phrase string, place int, title string")
    info = spark.createDataFrame([(f"t{i}", "image/png", 300, 300, f"u{i % 3}", "", None, None, None, None) for i in range(4)],
                                 "title string, mime string, width int, height int, url string, description string, artist string, licence string, licence_url string, page_url string")
    seen = spark.createDataFrame([("u1",), ("u1",), (None,)], "url string")
    taken = lambda **more: [r.title for r in ingest.scraped(listed, info, ["category", "place"], 10, 9, **more)[1].orderBy("image_id").collect()]
    assert taken() == ["t0", "t1", "t2"] and taken(seen=seen) == ["t0", "t2"]
