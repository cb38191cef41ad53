"""Caption vectors in the images' space, components folded batch by batch, stored frequencies, and tokens by the treebank's rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.functions import text as T
from lanternfish.functions import vector as V
from lanternfish.operators import folded, graph, metrics, selection, spaces


@pytest.fixture(scope="module")
def world(spark):
    """Images whose vectors are sums of their subjects', and captions that name these among other words."""
    rng = np.random.default_rng(2)
    subjects, fill = [f"thing{i}" for i in range(40)], [f"word{i}" for i in range(60)]
    meaning = rng.normal(size=(40, 24))
    captions, images = [], []
    for i in range(900):
        about = rng.choice(40, 3, replace=False)
        images.append((i, (meaning[about].sum(axis=0) + rng.normal(size=24) * 0.5).astype(np.float32).tolist()))
        for _ in range(2):
            words = [subjects[j] for j in about] + list(rng.choice(fill, 6))
            captions.append((i, " ".join(rng.permutation(words)) + "."))
    captions += [(3, None), (4, ""), (5000, "no image")]
    return (spark.createDataFrame(captions, "image_id long, document string").repartition(4).cache(), spark.createDataFrame(images + [(901, None)], "image_id long, embedding array<float>").repartition(3).cache())


def test_held_out_captions_find_their_images(spark, world):
    captions, images = world
    held = F.col("image_id") % 9 == 0
    space = spaces.fit(captions.where(~held), images.where(~held))
    got = spaces.own_rank(space, captions.where(held & (F.length("document") > 0)), images.where(held)).collect()
    assert len(got) == 200 and all(1 <= r["rank"] <= r["of"] == 100 for r in got)
    assert np.mean([r["rank"] for r in got]) < 5 and np.mean([r["rank"] == 1 for r in got]) > 0.6  # by chance 50.5 and 0.01
    nothing = spaces.own_rank(spaces.fit(captions.withColumn("document", F.lit("same")), images), captions.where(held & (F.length("document") > 0)), images.where(held)).collect()
    assert np.mean([r["rank"] for r in nothing]) > 30


def test_space_against_one_solution(spark, world):
    """The sums of tasks are those of the whole table."""
    captions, images = world
    space = spaces.fit(captions, images, places=32)
    pairs = captions.where("document is not null").join(images, "image_id").select(F.transform(T.tokens(F.col("document")), lambda w: F.pmod(F.xxhash64(w), F.lit(32)).cast("int")).alias("w"), "embedding").collect()
    x = np.zeros((len(pairs), 33))
    for k, r in enumerate(pairs):
        np.add.at(x[k], r.w, 1.0)
    x[:, :32] = np.log1p(x[:, :32])
    x[:, :32] /= np.clip(np.linalg.norm(x[:, :32], axis=1, keepdims=True), 1e-8, None)
    x[:, 32] = 1
    y = np.array([r.embedding for r in pairs], dtype=float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    damp = np.diag([1e-3 * len(x)] * 32 + [1e-9 * len(x)])
    assert space.captions == len(x) == 1801 and np.allclose(space.weights, np.linalg.solve(x.T @ x + damp, x.T @ y), atol=1e-8)
    assert spaces.fit(captions.where("false"), images) is None


def test_said_vectors_serve_scores_and_medoids(spark, world):
    captions, images = world
    space = spaces.fit(captions, images)
    said = space.said(captions.select("document")).cache()
    assert said.count() == captions.select("document").distinct().count()
    scored = captions.join(images, "image_id").join(said.withColumnRenamed("embedding", "t"), "document").where("document <> ''")
    own = scored.select(V.clip_score(V.dot(V.normalise(F.col("embedding")), V.normalise(F.col("t"))), F.col("document")).alias("s")).agg(F.avg("s")).first()[0]
    other = scored.withColumn("other", (F.col("image_id") + 1) % 900).drop("embedding").join(images.withColumnRenamed("image_id", "other"), "other")
    chance = other.select(V.clip_score(V.dot(V.normalise(F.col("embedding")), V.normalise(F.col("t"))), F.col("document")).alias("s")).agg(F.avg("s")).first()[0]
    assert own > 1.5 > 1.0 > chance
    pool = captions.where("image_id < 4 and document is not null").selectExpr("1L as query_id", "0 as variant_no", "cast(image_id * 2 as int) as rank", "document", "0.5d as distance")
    assert selection.select_medoid(pool, said).count() == 1


def test_folded_components(spark, tmp_path):
    """Ten batches are one run, and so they are on the way; a batch that comes twice changes nothing; what a batch doesn't touch isn't written."""
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(200, 240)] + [(300, 300 + i) for i in range(1, 40)] + [(7, None), (8, 8)]
    rng.shuffle(links)
    at = folded.Folded(spark, f"{tmp_path}/f")
    schema, parent, sizes = "x long, y long", {}, []

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k in range(10):
        batch = links[k::10]
        for a, b in batch:
            if a is not None and b is not None and a != b:
                x, y = sorted((find(parent.setdefault(a, a)), find(parent.setdefault(b, b))))
                parent[y] = x
        at.fold(spark.createDataFrame(batch, schema))
        if k in (0, 4, 9):
            got = {r.node: r.root for r in at.labels().collect()}
            assert got == {n: find(n) for n in parent}
        sizes.append(at.table.snapshot().manifest.batches[-1]["rows"])
    whole = {r.a: r.b for r in graph.components(spark.createDataFrame(links, schema)).collect()}
    assert all(got[n] == whole.get(n, n) for n in got)
    at.fold(spark.createDataFrame(links[:20], schema))
    at.fold(spark.createDataFrame([], schema))
    assert {r.node: r.root for r in at.labels().collect()} == got and {r.node: r.root for r in at.labels(10).collect()} == got
    assert max(sizes[5:]) < len(parent) / 2


def test_stored_frequencies(spark):
    rng = np.random.default_rng(1)
    words = ["the"] * 6 + [f"w{i}" for i in range(12)]
    say = lambda: " ".join(rng.choice(words, 9))
    refs = spark.createDataFrame([(i, say()) for i in range(30) for _ in range(3)], "item long, reference string")
    cand = spark.createDataFrame([(i, say()) for i in range(30)], "item long, candidate string")
    parts = [metrics.gram_frequencies(refs.where(F.col("item") % 3 == k)) for k in range(3)]
    stored = metrics.merged_frequencies(*parts)
    key = lambda df: {(r.n, r.gram): r.df for r in df.collect()}
    assert key(stored) == key(metrics.gram_frequencies(refs)) and key(stored)[0, None] == 30
    score = lambda df: {r.item: round(r.cider, 9) for r in df.collect()}
    assert score(metrics.cider(cand, refs, frequencies=stored)) == score(metrics.cider(cand, refs))
    some = metrics.cider(cand.where("item < 5"), refs.where("item < 5"), frequencies=stored)
    whole = score(metrics.cider(cand, refs))
    assert score(some) == {i: whole[i] for i in range(5)}  # a new run scores as if the corpus had been counted


# Texts and their tokens by the treebank's published rules.
TREEBANK = [
    ("They'll save and invest more.", "They 'll save and invest more ."), ("hi, my name can't hello,", "hi , my name ca n't hello ,"), ("Good muffins cost $3.88 in New York.", "Good muffins cost $ 3.88 in New York ."),
    ("\"We beat some pretty good teams,\" he said.", "`` We beat some pretty good teams , '' he said ."), ("I cannot cannot work under these conditions!", "I can not can not work under these conditions !"),
    ("The company spent $30,000,000 last year.", "The company spent $ 30,000,000 last year ."), ("The company spent 40.75% of its income last year.", "The company spent 40.75 % of its income last year ."),
    ("He arrived at 3:00 pm.", "He arrived at 3:00 pm ."), ("I bought these items: books, pencils, and pens.", "I bought these items : books , pencils , and pens ."), ("a man (with a dog) -- it's his", "a man -LRB- with a dog -RRB- -- it 's his"),
    ("What's that? It isn't mine; we're gonna see...", "What 's that ? It is n't mine ; we 're gon na see ..."), ("the dog's bone and the dogs' bones", "the dog 's bone and the dogs ' bones"),
]


def test_treebank_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TREEBANK)] + [(90, None), (91, ""), (92, "  \n ")], "i long, t string")
    got = {r.i: r.w for r in df.select("i", T.ptb_tokens(F.col("t"), lower=False, keep_punctuation=True).alias("w")).collect()}
    assert [" ".join(got[i]) for i in range(len(TREEBANK))] == [w for _, w in TREEBANK] and got[90] == got[91] == got[92] == []
    bare = {r.i: r.w for r in df.select("i", T.ptb_tokens(F.col("t")).alias("w")).collect()}
    assert bare[3] == "we beat some pretty good teams he said".split() and bare[9] == "a man with a dog it 's his".split()
    cand = df.select(F.col("i").alias("item"), F.col("t").alias("candidate")).where("item < 3")
    refs = cand.withColumnRenamed("candidate", "reference")
    assert [round(r.rouge_l, 9) for r in metrics.rouge_l(cand, refs, split=T.ptb_tokens).collect()] == [1.0] * 3
