"""Samples, co-training and the field against plain versions on small data."""

import itertools
import math
import pickle
import zlib

import numpy as np
from pyspark.sql import functions as F

from lanternfish.llm import quality, samples, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def hashes(spark, ids, seed):
    return {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", F.xxhash64("i", F.lit(seed))).collect()}


def first(spark, ids, most, seed=0):
    h = hashes(spark, ids, seed) if ids else {}
    return sorted(ids, key=lambda i: (h[i], i))[:most]


def test_samples_hold_what_is_there(spark):
    """Labels of absent ids take no place, an id that repeats is one row, and bytes are bounded."""
    docs = spark.createDataFrame([(i, "x" * (10 + i % 7)) for i in range(300)] + [(5, f"copy {k}") for k in range(500)] + [(400, "y" * 5000), (None, "z")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(i, i % 2) for i in range(1000, 3000)] + [(400, 1), (None, 1), (7, 0), (8, None)], "doc_id bigint, toxic int")
    known = samples.labelled(docs, labels, "toxic", "doc_id")
    want = {i: i % 2 for i in range(300) if not held(i)} | {i: 1 for i in (400,) if not held(i)}
    assert {r["__id"]: r["__y"] for r in known.collect()} == want
    picked = samples.first_ids(known.where("__y = 0"), 40).unionByName(samples.first_ids(known.where("__y = 1"), 40))
    ids = {y: first(spark, [i for i, v in want.items() if v == y], 40) for y in (0, 1)}
    assert sorted(r["__id"] for r in picked.collect()) == sorted(ids[0] + ids[1])
    got = samples.whole_rows(docs, picked, "doc_id", ["text"], "text", F.col("__y"), 10**9).collect()
    assert sorted(r["__id"] for r in got) == sorted(ids[0] + ids[1])
    most = 300
    got = samples.whole_rows(docs, picked, "doc_id", ["text"], "text", F.col("__y"), most).collect()
    size = {r["__id"]: len(r.text) for r in got}
    for y in (0, 1):
        mine = [i for i in size if want[i] == y]
        assert 0 < sum(size[i] for i in mine) <= most and 400 not in mine
    assert samples.whole_rows(docs, picked.where("false"), "doc_id", ["text"], "text", F.col("__y"), 10).count() == 0


def test_co_training_against_a_plain_loop(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("doc_id % 3 = 0")
    got = {r.doc_id: r for r in quality.quality(docs, labels, fit_most=40, taught=0.3, rounds=2).collect()}
    rows = [{"__id": r.doc_id, "__text": (r.text or "").encode() if r.text is not None else None, "__lang": r.lang, "__source": r.source, "__chars": None if r.n_chars is None else float(r.n_chars)} for r in docs.collect()]
    said = {r.doc_id: int(r.quality == 1) for r in labels.collect() if r.quality is not None}
    known = {i: y for i, y in said.items() if not held(i) and i in got}
    picked = first(spark, [i for i, y in known.items() if y == 0], 40) + first(spark, [i for i, y in known.items() if y == 1], 40)
    by = {r["__id"]: r for r in rows}
    fitted = [by[i] | {"__y": known[i], "__text_y": None, "__page_y": None} for i in picked]
    free = [r for r in rows if not held(r["__id"]) and r["__id"] not in {r.doc_id for r in labels.collect()}]
    taught, most = [], max(1, int(0.3 * len(fitted) / 2))
    for turn in range(2):
        text, page = quality.teach(fitted, taught)
        done = {r["__id"] for r in taught}
        p = [quality.sigmoid(v.logits([f(r) for r in free])) for v, f in ((text, quality._text), (page, quality._page))]
        drawn = {}
        for k, other in ((0, "__page_y"), (1, "__text_y")):
            for y in (0, 1):
                sure = [r["__id"] for r, x in zip(free, p[k]) if r["__id"] not in done and max(x, 1 - x) > 0.9 and int(x > 0.5) == y]
                for i in first(spark, sure, most, 1 + turn):
                    drawn.setdefault(i, {"__text_y": None, "__page_y": None})[other] = y
        taught += [by[i] | {"__y": None} | ys for i, ys in drawn.items()]
    assert len(taught) > 20
    prior = sum(known.values()) / len(known)
    scorer = quality.combined(quality.teach(fitted, taught), fitted, prior)
    s, a, b = scorer.score([quality._text(r) for r in rows], [quality._page(r) for r in rows])
    for r, *want in zip(rows, s, a, b):
        g = got[r["__id"]]
        assert np.allclose([g.score, g.text_score, g.page_score], want, atol=1e-9)


def chains(texts, tagger):
    """(probability of state 1 of each word, log of the sum over all taggings) of each text, by listing all taggings."""
    out = []
    for t in texts:
        words = t.split()
        w = [[sum(tagger.weight[k][tagger.index[f]] for f in toxicity.features(x) if f in tagger.index) for k in range(3)] for x in words]
        own, before, after = (np.array([x[k] for x in w]) for k in range(3))
        e = own + tagger.bias
        e[1:] += before[:-1]
        e[:-1] += after[1:]
        z, p = 0.0, np.zeros(len(words))
        for s in itertools.product((0, 1), repeat=len(words)):
            v = math.exp(sum(e[i] * s[i] for i in range(len(s))) + sum(tagger.trans[s[i], s[i + 1]] for i in range(len(s) - 1)))
            z, p = z + v, p + v * np.array(s)
        out.append((p / z, math.log(z), e))
    return out


def test_field_against_all_taggings():
    rng = np.random.default_rng(1)
    calm, vile = [f"calm{i}" for i in range(12)], ["vile", "vilest", "foul"]
    texts, toxic = [], []
    for n in range(120):
        words = list(rng.choice(calm, 6))
        if n % 3 == 0:
            words[int(rng.integers(0, 5))] = str(rng.choice(vile))
        texts.append(f"{' '.join(words)} w{n}".encode())
        toxic.append(int(n % 3 == 0))
    tagger = pickle.loads(toxicity.fit(texts, np.array(toxic), 1 / 3, epochs=60))
    p, size = tagger.marginals(texts)
    at = np.r_[0, np.cumsum(size)]
    listed = chains(texts, tagger)
    for k, (want, _, _) in enumerate(listed):
        assert np.allclose(p[at[k] : at[k + 1]], want, atol=1e-6)
    gold = [np.array([float(w.decode() in vile) for w in t.split()]) for t in texts]
    for want, g in zip(listed, gold):
        assert ((want[0] >= 0.5) == (g == 1)).all()

    def fit_of(t):
        return sum((e * g).sum() + sum(t.trans[int(g[i]), int(g[i + 1])] for i in range(len(g) - 1)) - z for (_, z, e), g in zip(chains(texts, t), gold))

    best = fit_of(tagger)
    assert best > -5 and best > fit_of(toxicity.Tagger(list(tagger.index), np.zeros_like(tagger.weight), -3.0, np.zeros((2, 2)), tagger.doc)) + 50
    score, _, _ = tagger.score(texts)
    assert min(s for s, y in zip(score, toxic) if y) > max(s for s, y in zip(score, toxic) if not y)
