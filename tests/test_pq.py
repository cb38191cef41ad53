"""Search by product-quantised codes: what it finds, what it computes, and the exact search, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.operators import approximate, knn, pq


def table(spark, rows, name="image_id"):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} bigint, embedding array<float>").repartition(5)


@pytest.fixture(scope="module")
def clustered(spark):
    """3,000 vectors around 150 middles, a third of all around the first; every 60th asks."""
    rng = np.random.default_rng(8)
    own = np.where(np.arange(3000) % 3 == 0, 0, rng.integers(0, 150, 3000))
    v = (rng.normal(size=(150, 32))[own] + rng.normal(size=(3000, 32)) * 0.25).astype(np.float32)
    images = table(spark, enumerate(v)).cache()
    queries = images.where("image_id % 60 = 0").withColumnRenamed("image_id", "query_id").cache()
    return images, queries, knn.top_images(queries, images, 10, True).cache()


@pytest.mark.parametrize("held", [pq.HELD, 200])
def test_recall_and_work(spark, monkeypatch, clustered, held):
    """Nine of ten neighbours, while a tenth of the vectors or fewer are scored exactly; hot lists are several parts."""
    monkeypatch.setattr(pq, "HELD", held)
    images, queries, exact = clustered
    index = pq.build(images, lists=24, parts=16)
    found = pq.search(queries, images, index, 10, probes=4, rerank=15, exclude_self=True)
    assert approximate.recall(found, exact).first().recall >= 0.9
    asked = pq.candidates(queries, index, 150, 4, True).groupBy("query_id").count().agg(F.max("count"), F.count("query_id")).first()
    assert asked[0] <= 0.1 * 3000 and asked[1] == 50
    best = {(r.query_id, r.image_id): r.cosine for r in exact.collect()}
    got = found.collect()
    assert all(r.query_id != r.image_id and abs(r.cosine - best[r.query_id, r.image_id]) < 1e-8 for r in got if (r.query_id, r.image_id) in best)
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, n) for q in range(0, 3000, 60) for n in range(1, 11)]


def test_exact_search(spark, monkeypatch, clustered):
    monkeypatch.setattr(pq, "HELD", 300)
    images, queries, exact = clustered
    want = {(r.query_id, r["rank"]): r.image_id for r in exact.collect()}
    for probes, parts, lists in ((1, 4, 24), (6, 8, 5)):  # bad guesses cost work only
        index = pq.build(images, lists=lists, parts=parts)
        assert {(r.query_id, r["rank"]): r.image_id for r in pq.exact_search(queries, images, index, 10, probes, True).collect()} == want
    assert pq.bounded(queries, images, pq.build(images, 24, 16), 10, 4, exclude_self=True).count() < 0.5 * 50 * 3000


def test_edges(spark):
    """Null and zero vectors, copies, odd widths, fewer images than are asked for, empty tables."""
    rows = [(0, [1, 0, 0, 0, 0]), (1, [0, 1, 0, 0, 0]), (2, [1, 0, 0, 0, 0]), (3, None), (4, [0, 0, 0, 0, 0]), (5, [2, 0.1, 0, 0, 0])]
    images = table(spark, rows)
    queries = table(spark, [(0, rows[0][1]), (1, rows[1][1]), (9, None)], "query_id")
    index = pq.build(images, lists=3, parts=2)
    want = sorted((r.query_id, r["rank"], r.image_id, r.cosine) for r in knn.top_images(queries, images, 4, True).collect())
    got = sorted((r.query_id, r["rank"], r.image_id, r.cosine) for r in pq.exact_search(queries, images, index, 4, 1, True).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    nothing = pq.build(images.where("false"))
    assert pq.exact_search(queries, images, nothing, 3).count() == 0 and pq.search(queries, images, nothing, 3).count() == 0
    assert pq.exact_search(queries.where("false"), images, index, 3).count() == 0
