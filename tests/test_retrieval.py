import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.functions import text as T
from lanternfish.operators import diagnostics, geometry, graph, ingest, knn, metrics, quantize, retrieve, selection, similar
from lanternfish.plans import catalogue
from lanternfish.sources import index as I

INDEX = "id string, image_id bigint, ann_id bigint, embedding array<float>, document string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def small_index(spark):
    return spark.createDataFrame([("1_1", 1, 1, [1.0, 0.0, 0.0, 0.0], "a heron waits by the weir."), ("1_9", 1, 9, [1.0, 0.0, 0.0, 0.0], "a heron."), ("2_2", 2, 2, [0.0, 1.0, 0.0, 0.0], "two mules cross the ford.")], INDEX)


def test_index_round_trip_and_hold_out(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert I.open_or_create(spark, path).count() == 0
    I.upsert(small_index(spark), path)
    back = I.open_or_create(spark, path)
    assert I.stats(back, "c").first()[:2] == (3, "c")
    held = I.hold_out(back, spark.createDataFrame([(1,)], "image_id bigint"))
    assert [r.id for r in held.collect()] == ["2_2"] and back.count() == 3
    assert [r[0] for r in back.orderBy("id").select(I.is_augmented(F.col("id"))).collect()] == [True, False, True]


def test_nearest_ties_and_exclusion(spark):
    i = small_index(spark)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (7, None)], "query_id bigint, embedding array<float>")
    got = [(r.rank, r.id, round(r.distance, 6)) for r in knn.nearest_captions(q, i, 2).orderBy("rank").collect()]
    assert got == [(1, "1_1", 0.0), (2, "1_9", 0.0)]
    assert [r.id for r in knn.nearest_captions(q, i, 2, exclude_self=True).collect()] == ["2_2"]
    assert knn.nearest_captions(q, i.where("false"), 2).count() == 0
    assert knn.top_images(q.where("false"), knn.images_of(i), 2).count() == 0
    blocks = knn.top_images(spark.range(9).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id") * 0.1, F.lit(0.0), F.lit(0.0)).cast("array<float>").alias("embedding")), knn.images_of(i), 1, block=2)
    assert {r.query_id for r in blocks.collect()} == set(range(9))


POOL = "query_id bigint, variant_no int, rank bigint, document string, distance double"


def test_selection(spark):
    pool = spark.createDataFrame([(1, 0, 1, "outlier caption.", 0.0), (1, 0, 2, "typical kind words.", 1.0), (1, 1, 1, "typical kind words too.", 2.0), (2, 0, 1, "alone", 3.0)], POOL)
    assert rows(selection.select_top1(pool)) == [(1, "outlier caption.", 0.0), (2, "alone", 3.0)]
    assert [r[:3] for r in rows(selection.select_medoid(pool))] == [(1, "typical kind words.", 1.0), (2, "alone", 3.0)]
    chosen = spark.createDataFrame([(1, "typical kind words too."), (2, "absent")], "query_id bigint, caption string")
    assert sorted(((r.query_id, r.distance) for r in selection.match_distance(pool, chosen).collect()), key=str) == [(1, 2.0), (2, None)]
    assert selection.choose(pool, "aggregated").where("distance is not null").count() == 0
    with pytest.raises(ValueError):
        selection.choose(pool, "nearest")
    tie = spark.createDataFrame([(1, 0, 1, "b", 0.5), (1, 1, 1, "a", 0.5)], POOL)
    assert rows(selection.select_top1(tie)) == [(1, "b", 0.5)]


def test_aggregate_captions(spark):
    long = " ".join(f"this is sentence number {i} in a long caption block." for i in range(50))
    blocks = spark.createDataFrame([(1, 1, "Kilns glow. Carts wait."), (1, 2, "a  x. kilns  GLOW.. Ferries leave"), (2, 1, ""), (2, 2, None), (2, 3, "hi."), (3, 1, long)], "query_id bigint, pos int, document string")
    got = dict(rows(selection.aggregate_captions(blocks)))
    assert got[1] == "Kilns glow. Carts wait. Ferries leave." and got[2] == ""
    assert len(got[3]) <= 501 and got[3].endswith(".")


def test_backends(spark):
    df = spark.createDataFrame([("x", 1.0)], "caption string, distance double")
    assert retrieve.generate(df).first().generated_caption == "x"
    with pytest.raises(ValueError):
        retrieve.generate(df, "other")
    with pytest.raises(RuntimeError):
        retrieve.generate(df, "blip")
    p = spark.createDataFrame([("A photo a fake caption.", "a photo")], "t string, p string")
    assert p.select(T.without_prompt(F.col("t"), F.col("p"))).first()[0] == "a fake caption."


def test_clusters(spark):
    pairs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(1, 40)] + [(50, 60, 0.8)], "a bigint, b bigint, cosine double")
    got = dict(rows(graph.clusters(pairs)))
    assert set(got.values()) == {1, 50} and len(got) == 42
    assert rows(graph.cluster_sizes(graph.clusters(pairs))) == [(1, 40), (50, 2)]
    assert graph.clusters(pairs.where("false")).count() == 0


def test_metrics(spark):
    c = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a dog"), (3, "unscored")], "item int, candidate string")
    ref = spark.createDataFrame([(1, "the cat sat on the mat"), (1, "a cat on a mat"), (2, "one bird")], "item int, reference string")
    assert metrics.bleu(c.where("item = 1"), ref).first()[:2] == (pytest.approx(1.0), 1)
    assert metrics.bleu(c.where("item = 2"), ref).first().bleu == 0.0
    score = {r.item: r.cider for r in metrics.cider(c, ref).collect()}
    assert set(score) == {1, 2} and score[1] > 3 and score[2] == 0.0
    assert metrics.rouge_l_of("a b c".split(), ["a c".split()]) == pytest.approx((1 + 1.44) * (2 / 3) * 1 / (1 + 1.44 * 2 / 3))
    assert metrics.rouge_l_of([], [["a"]]) == 0.0
    assert metrics.meteor_exact_of("dogs run".split(), ["dog run".split()]) == pytest.approx(1 - 0.5 * (1 / 2) ** 3)
    assert metrics.rouge_l(c, ref).count() == 2 and metrics.meteor_exact(c, ref).count() == 2


def test_quantise(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "image_id bigint, embedding array<float>")
    got = {r.image_id: list(r.codes) for r in quantize.int8_round_trip(v).collect()}
    assert got == {1: [95, 127], 2: [0, 0]}
    assert quantize.memory_table(v).where("precision = 'int8'").first().bytes == 4


def test_geometry(spark):
    box = spark.createDataFrame([(1, 0, 0, 10, 10, 200, 200), (2, 0, 0, 100, 100, 200, 200), (3, 40, 40, 60, 60, 100, 100)], "image_id int, x0 int, y0 int, x1 int, y1 int, width int, height int")
    assert rows(geometry.crop_boxes(box, 0, 64).select("image_id", "x0", "y0", "x1", "y1")) == [(2, 0, 0, 100, 100)]
    assert (3, 0, 0, 100, 100) in rows(geometry.crop_boxes(box, 50, 10).select("image_id", "x0", "y0", "x1", "y1"))
    r = geometry.random_boxes(spark.createDataFrame([(5, 100, 50)], "image_id bigint, width int, height int")).collect()
    assert len(r) == 6 and all(0 <= b.x0 < b.x1 <= 100 and 0 <= b.y0 < b.y1 <= 50 for b in r)


def test_ingest(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "image_id bigint, ann_id bigint, caption string")
    assert ingest.merge([a, a.withColumn("image_id", F.lit(2).cast("bigint"))]).count() == 4
    with pytest.raises(ValueError):
        ingest.merge([a, a])
    n = ingest.numbered(spark.range(1000).repartition(7), ["id"], 50)
    assert n.where("image_id <> id + 50").count() == 0
    with pytest.raises(ValueError):
        ingest.with_templates(spark.createDataFrame([(3,)], "label int"), spark.createDataFrame([(1, "x")], "label int, caption string"))
    photo = spark.createDataFrame([("image/png", 300, 300, "u", "a cat"), ("image/png", 300, 300, "u", "Flag of X"), ("image/gif", 300, 300, "u", "a"), ("image/png", None, 300, "u", "a"), ("image/jpeg", 300, 300, "", "a")], "mime string, width int, height int, url string, title string")
    assert ingest.is_photo(photo).count() == 1
    d = spark.createDataFrame([("<p>A quiet river  bank</p>", "x"), ("short", "river"), (None, "y"), ("An old coat of arms here", "z")], "html string, phrase string")
    assert [r.caption for r in ingest.captioned(d).collect()] == ["A quiet river bank", "A photograph of river.", "A photograph of y.", "A photograph of z."]
    direct = spark.createDataFrame([("c", "t1", 1), ("c", "t2", 2)], "category string, title string, pos int")
    assert rows(ingest.categories(direct, direct.withColumn("title", F.lit("t0")), 2)) == [("c", "t1"), ("c", "t2")]


def test_diagnostics(spark):
    lat = spark.createDataFrame([("a", float(v)) for v in range(1, 101)], "s string, v double")
    assert rows(diagnostics.percentiles(lat, "s", "v")) == [("a", 0.5, 51.0), ("a", 0.95, 96.0), ("a", 0.99, 100.0)]
    assert diagnostics.stride_sample(spark.range(100), "id", 10).count() == 10
    ranks = spark.createDataFrame([(1, 1), (2, 6)], "query_id bigint, first_hit int")
    got = diagnostics.recall_at(ranks, spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint"), (1, 5, 10))
    assert [(r.k, r.hits) for r in got.orderBy("k").collect()] == [(1, 1), (5, 1), (10, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"annotations": [{"image_id": 1, "id": 2, "caption": "c"}]}')
    (tmp_path / "h.json").write_text('{"12": "hand"}')
    (tmp_path / "i").mkdir()
    for name in ("7.jpg", "8.JPG", "x.png"):
        (tmp_path / "i" / name).write_bytes(b"x")
    assert rows(I.read_annotations(spark, f"file://{tmp_path}/a.json")) == [(1, 2, "c")]
    assert rows(I.read_hand_labels(spark, f"file://{tmp_path}/h.json")) == [(12, "hand")]
    assert [r.image_id for r in I.read_images(spark, f"file://{tmp_path}/i").collect()] == [7]
    assert I.read_images(spark, f"file://{tmp_path}/i", True).count() == 3
    assert I.markdown([{"a": 1, "b": 0.5}]).splitlines()[2] == "| 1 | 0.5000 |"
    built = I.build_index(I.read_annotations(spark, f"file://{tmp_path}/a.json"), spark.createDataFrame([(1, [1.0])], "image_id bigint, embedding array<float>"))
    assert built.first().id == "1_2"


def test_stream(spark, tmp_path):
    from lanternfish.streaming.captions import caption_stream

    src = f"file://{tmp_path}/in"
    q = spark.createDataFrame([(9, [1.0, 0.0, 0.0, 0.0])], "query_id bigint, embedding array<float>")
    q.write.parquet(src)
    stream = spark.readStream.schema(q.schema).parquet(src)
    caption_stream(stream, small_index(spark), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", "top1").awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").first().caption == "a heron waits by the weir."


def test_audit(spark):
    pairs = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.96), (7, 8, 0.97)], "a long, b long, cosine double")
    members = graph.clusters(pairs)
    got = graph.audit(graph.best_partner(pairs), members, spark.createDataFrame([(1,), (9,)], "image_id long")).first().asDict()
    assert got == {"near_duplicates": 5, "near_exact": 2, "clusters": 2, "members": 5, "largest": "3 2", "sampled": 2, "flagged": 1, "flagged_pct": 50.0}
    none = pairs.limit(0)
    got = graph.audit(graph.best_partner(none), graph.clusters(none), spark.createDataFrame([], "image_id long")).first().asDict()
    assert got == {"near_duplicates": 0, "near_exact": 0, "clusters": 0, "members": 0, "largest": "", "sampled": 0, "flagged": 0, "flagged_pct": None}


def test_order_mismatches(spark):
    a = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "id string, n int")
    assert tuple(diagnostics.order_mismatches(a, ["id"], a, ["n"]).first()) == (3, 3, 2)
    assert tuple(diagnostics.order_mismatches(a, ["id"], a, ["id"]).first()) == (3, 3, 0)
    assert tuple(diagnostics.order_mismatches(a, ["id"], a.where("n > 1"), ["id"]).first()) == (3, 2, 1)


def test_ablation(spark):
    rows = [(5, 0, 1, "near", 0.1, "original"), (5, 1, 1, "nearest", 0.0, "segment"), (5, 2, 1, "far", 0.9, "object")]
    pool = spark.createDataFrame(rows, "query_id long, variant_no int, rank int, document string, distance double, kind string")
    got = {(r.crops, r.mode): r.caption for r in retrieve.ablation(pool).collect()}
    assert len(got) == 15 and got["none", "top1"] == got["random", "top1"] == "near"
    assert got["segmentation", "top1"] == got["both", "top1"] == "nearest" and got["object-detection", "top1"] == "near"
    assert got["both", "aggregated"] == "near. nearest."
    with pytest.raises(ValueError):
        retrieve.ablation(pool, crops=("all",))


def test_gallery_entry(spark):
    runs = spark.createDataFrame([("medoid__none", 1, "x", 0.5), ("top1__none", 1, "y", 0.25)], "config string, image_id long, caption string, score double")
    made = ingest.gallery(runs, spark.createDataFrame([(1, 2, "ref")], "image_id long, ann_id long, caption string"))
    assert ingest.chosen_entry(made, "top1", "none").select("caption", "score").first()[:] == ("y", 0.25)
    assert ingest.chosen_entry(made).select("caption", "score").first()[:] == (None, None)


def test_quantized_downstream(spark):
    """Against numpy on the smallest tables."""
    folder = "/root/testdata/sf0.001"
    rows = catalogue.caption_index(spark, folder).collect()
    vector = {r.image_id: np.array(r.embedding, dtype=np.float64) for r in rows}
    first = {m: min((r.ann_id, r.id) for r in rows if r.image_id == m)[1] for m in vector}
    unit = {m: v / np.linalg.norm(v) for m, v in vector.items()}
    half = {m: v.astype(np.float32).astype(np.float16).astype(np.float64) for m, v in unit.items()}
    half = {m: v / np.linalg.norm(v) for m, v in half.items()}
    asked = {r.query_id: np.array(r.embedding, dtype=np.float64) for r in catalogue.asked(spark, folder).collect()}

    def top(q, v, table):
        return first[min((m for m in table if m != q), key=lambda m: (-float(v @ table[m]), m))]

    flips = 0
    for q, v in asked.items():
        v = v / np.linalg.norm(v)
        h = v.astype(np.float32).astype(np.float16).astype(np.float64)
        flips += top(q, v, unit) != top(q, h / np.linalg.norm(h), half)
    got = catalogue.QUERIES["quantized_downstream"](spark, folder).first()
    assert (got.queries, got.flips) == (len(asked), flips) and got.delta == got.float16 - got.float32


def test_metric_table(spark):
    folder = "/root/testdata/sf0.001"
    for row in catalogue.QUERIES["metric_table"](spark, folder).collect():
        each = [r[row.metric] for r in catalogue.QUERIES[row.metric](spark, folder).collect()]
        assert row.n == len(each) and row["mean"] == pytest.approx(sum(each) / len(each), abs=1e-6)


def test_numbers_of_many_wide_rows(spark):
    """Every row once and every number once, whatever the partitions; also where one value is most of the table."""
    df = spark.range(2_000_000).select("id", F.repeat(F.md5(F.col("id").cast("string")), 4).alias("wide"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("hot"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, order in ((8, ["wide"]), (64, ["wide"]), (200, ["hot"])):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = ingest.numbered(df, order, 5)
            row = got.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "wide").cast("decimal(38,0)")), F.countDistinct("image_id"), F.min("image_id"), F.max("image_id")).first()
            want = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "wide").cast("decimal(38,0)"))).first()
            assert tuple(row) == (*want, 2_000_000, 5, 2_000_004)
            assert got.alias("x").join(got.alias("y"), F.col("x.image_id") + 1 == F.col("y.image_id")).where(F.col(f"x.{order[0]}") > F.col(f"y.{order[0]}")).isEmpty()
        assert diagnostics.order_mismatches(df, ["wide"], df, ["wide"]).first()[:] == (2_000_000, 2_000_000, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_what_is_no_photograph(spark):
    titles = {"Screenshot of a menu": True, "route map 7": True, "City graph": True, "A SYMBOL": True, "Coat of arms of X": True, "The seal of Y": True, "flag of Z": True, "logo": True, "Emblem.png": True, "map of A": True,
              "Diagram 2": True, "icon": True, "pie chart": True, "Locator map": True, "banner": True, "poster": False, "stamp": False, "insignia": False, "iconic view": False, "éicon": False, "logo_2": False, "graphs": False, None: False}
    got = {r.t: r.b for r in spark.createDataFrame([(t,) for t in titles], "t string").select("t", T.is_blocked(F.col("t")).alias("b")).collect()}
    assert got == titles


def vectors(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "image_id bigint, embedding array<float>")


@pytest.mark.parametrize("side", [3, 1000])
def test_similar_pairs(spark, side):
    """Against all pairs; equal vectors are paired with their least id only, and nothing that links is lost."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    v = np.array([base[i % 6] + rng.normal(size=8) * 0.3 for i in range(40)], dtype=np.float32)
    rows = [*enumerate(v), (50, v[3]), (51, v[3]), (52, v[7]), (60, np.zeros(8)), (61, np.zeros(8))]
    df = vectors(spark, rows)
    unit = {i: x / max(np.linalg.norm(x.astype(float)), 1e-8) for i, x in ((i, np.asarray(x, dtype=np.float32).astype(float)) for i, x in rows)}
    cosine = {(a, b): round(float(unit[a] @ unit[b]), 9) for a in unit for b in unit if a < b}
    least = {50: 3, 51: 3, 52: 7}
    want = {p: c for p, c in cosine.items() if c >= 0.9 and not least.keys() & set(p)} | {(r, m): 1.0 for m, r in least.items()}
    got = {(r.a, r.b): r.cosine for r in similar.similar_pairs(df, 0.9, side).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-8 for p in got)
    assert {(r.image_id, r.least) for r in similar.classes(df).collect()} == {(3, 3), (50, 3), (51, 3), (7, 7), (52, 7), (60, 60), (61, 60)}
    label = {i: i for i in unit}
    for a, b in (p for p, c in cosine.items() if c >= 0.9):
        x, y = label[a], label[b]
        label = {k: min(x, y) if l in (x, y) else l for k, l in label.items()}
    members = {r.image_id: r.cluster for r in graph.clusters(similar.similar_links(df, 0.9, side)).collect()}
    assert members == {i: l for i, l in label.items() if list(label.values()).count(l) > 1}
    best = {r.image_id: (r.partner, r.cosine) for r in similar.best_partners(df, 0.9, side).collect()}
    assert best.keys() == members.keys()
    for i, (p, c) in best.items():
        assert abs(c - max(x for q, x in cosine.items() if i in q)) < 1e-8 and abs(cosine[min(i, p), max(i, p)] - c) < 1e-8
    assert similar.similar_pairs(df.where("false"), 0.9).count() == 0


def test_rounds_and_batches_give_one_ranking(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 4)).astype(np.float32)
    v[100:200] = v[7]  # a third of all images have one vector
    images = vectors(spark, enumerate(v)).repartition(5)
    q = images.where("image_id % 3 = 0").withColumnRenamed("image_id", "query_id")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    want = {(i, r + 1): j for i in range(0, 300, 3) for r, j in enumerate([j for j in np.lexsort((np.arange(300), -s[i])) if j != i][:10])}
    for size in (32 << 20, 1000):
        got = {(r.query_id, r["rank"]): r.image_id for r in knn.top_images(q, images, 10, True, round_bytes=size, block=17).collect()}
        assert got == want


def test_hubs_and_long_chains(spark):
    hub = [(0, i) for i in range(1, 3000)] + [(10_000 + i, 10_001 + i) for i in range(500)] + [(2999, 20_000), (None, 3), (5, 5)]
    got = dict(rows(graph.components(spark.createDataFrame(hub, "x bigint, y bigint").repartition(8))))
    assert {n for n, r in got.items() if r == 0} == {*range(1, 3000), 20_000}
    assert {n for n, r in got.items() if r == 10_000} == set(range(10_001, 10_501)) and len(got) == 3000 + 500


def test_contraction_does_not_depend_on_its_runs(spark):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    links = rng.integers(0, 200, (300, 2))
    whole = graph.components(spark.createDataFrame([(int(a), int(b)) for a, b in links], "x bigint, y bigint"))
    batches = [pa.RecordBatch.from_arrays([pa.array(links[i : i + 7, 0]), pa.array(links[i : i + 7, 1])], names=["a", "b"]) for i in range(0, 300, 7)]
    before, graph.CHUNK = graph.CHUNK, 20
    try:
        parts = [(a, b) for r in graph._contract(iter(batches)) for a, b in zip(*(c.to_pylist() for c in r.columns))]
    finally:
        graph.CHUNK = before
    assert rows(graph.components(spark.createDataFrame(parts, "x bigint, y bigint"))) == rows(whole)


def test_variants_have_two_keys(spark):
    big = 2**62
    i = small_index(spark)
    v = spark.createDataFrame([(4, n, [1.0, 0.0, 0.0, 0.0] if n % 2 else [0.0, 1.0, 0.0, 0.0]) for n in range(1500)] + [(big, 0, [0.0, 1.0, 0.0, 0.0]), (-big, 1, [1.0, 0.0, 0.0, 0.0])], "query_id bigint, variant_no int, embedding array<float>")
    got = {(r.query_id, r.variant_no): r.id for r in retrieve.variant_pool(v, i, 1).collect()}
    assert len(got) == 1502 and got[4, 1000] == "2_2" and got[4, 1499] == "1_1" and got[big, 0] == "2_2" and got[-big, 1] == "1_1"
    answered = {r.query_id: r.variants for r in retrieve.advanced(v, i, "top1").collect()}
    assert answered == {4: 1500, big: 1, -big: 1}
    pool = retrieve.variant_pool(v.where("variant_no < 2"), i, 1).withColumn("kind", F.when(F.col("variant_no") == 0, "original").otherwise("segment"))
    assert {r.query_id for r in retrieve.ablation(pool, ("none", "both"), ("top1",)).collect()} == {4, big, -big}


def test_percentiles_split_a_group(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "other").alias("g"), F.when(F.col("id") % 7 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v")).unionByName(spark.createDataFrame([("none", None), ("one", 2.0)], "g string, v double"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        by = {}
        for r in df.where("v is not null").collect():
            by.setdefault(r.g, []).append(r.v)
        want = {(g, p, sorted(x)[min(int(len(x) * p), len(x) - 1)]) for g, x in by.items() for p in (0.5, 0.95, 0.99)}
        assert {(r.g, r.p, r.latency) for r in diagnostics.percentiles(df, "g", "v").collect()} == want
        got = {r.g: (r["median"], r.n) for r in diagnostics.summary(df, ["g"], "v").collect()}
        assert got == {**{g: (float(np.median(x)), len(x)) for g, x in by.items()}, "none": (None, 0)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from lanternfish.sources import scratch

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(away)
    t = scratch.written(spark.range(3), "kept")
    assert t.count() == 3 and t._shared_path.startswith(scratch.own_dir(spark))


def test_median_first_hit_and_further_twins(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 6), (3, 2), (4, 5)], "query_id bigint, first_hit int")
    assert diagnostics.median_first_hit(ranks).first()[:] == (4, 3.5)
    assert diagnostics.median_first_hit(ranks.where("false")).first()[:] == (0, None)
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)], "image_id bigint, cluster bigint")
    assert graph.further_twins(spark.createDataFrame([(1,), (2,), (9,)], "image_id bigint"), members).first()[:] == (3, 3, 1)
