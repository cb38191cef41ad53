"""One query for each operator family, over the tables of a folder, and the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.functions import text as T
from lanternfish.functions import vector as V
from lanternfish.operators import approximate, diagnostics, folded, geometry, graph, ingest, knn, metrics, near_text, pq, quantize, retrieve, selection, similar, spaces
from lanternfish.plans.oracles import ORACLE_SQL
from lanternfish.sources import index as I
from lanternfish.sources import snapshots
from lanternfish.sources.scratch import new_path, written

__all__ = ["ORACLE_SQL", "QUERIES"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: No two vectors of these tables are as close as 0.95, so twins are sought from here on.
TWIN = 0.35


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def caption_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with an id as a caption, its whole text, dealt to images by id. Images of labels 7 to 9 are augmented: the two
    numbers of their first row are the same. Further rows of any image are numbered by their document."""
    e, d = table(spark, folder, "embeddings"), table(spark, folder, "documents")
    image = F.pmod("doc_id", F.lit(e.count())).alias("vec_id")
    first = d.select("doc_id", image).groupBy("vec_id").agg(F.min("doc_id").alias("first"))
    rows = d.select("doc_id", F.col("text").alias("document"), image).join(e.join(first, "vec_id"), "vec_id")
    ann = F.when((F.col("label") >= 7) & (F.col("doc_id") == F.col("first")), F.col("vec_id")).otherwise(1000000 + F.col("doc_id"))
    return rows.select(I.compose_id(F.col("vec_id"), ann).alias("id"), F.col("vec_id").alias("image_id"), ann.alias("ann_id"), (F.col("label") >= 7).alias("is_augmented"), "document", "embedding")


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """The query set of every search: images whose id is divisible by 50, against all rows."""
    return table(spark, folder, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def dealt_images(spark: SparkSession, folder: str) -> DataFrame:
    """The images of the index with their vectors, from the table that has each once."""
    e, d = table(spark, folder, "embeddings"), table(spark, folder, "documents")
    used = d.where("doc_id is not null").select(F.pmod("doc_id", F.lit(e.count())).alias("image_id")).distinct()
    return e.select(F.col("vec_id").alias("image_id"), "embedding").join(used, "image_id", "left_semi")


def pool(spark: SparkSession, folder: str, k: int = 5) -> DataFrame:
    """The candidates of every query, written once: selections read them several times."""
    return written(retrieve.pool_of(asked(spark, folder), caption_index(spark, folder), k, True, dealt_images(spark, folder)), "pool")


def r(c, n: int = 6):
    return F.round(c, n)


@query
def index_stats(spark, folder):
    return I.stats(caption_index(spark, folder), "captions")


@query
def index_ids(spark, folder):
    i = caption_index(spark, folder)
    return i.select("id", I.image_of(F.col("id")).alias("image_id"), I.is_augmented(F.col("id")).alias("is_augmented"), (I.compose_id(F.col("image_id"), F.col("ann_id")) == F.col("id")).alias("composed"))


@query
def subset_counts(spark, folder):
    tagged = caption_index(spark, folder).withColumn("subset", I.subset(F.col("ann_id")))
    return tagged.groupBy("is_augmented", "subset").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("images"))


@query
def captions_by_image(spark, folder):
    all_ = F.array_sort(F.collect_list(F.struct("ann_id", "document")))
    return caption_index(spark, folder).groupBy("image_id").agg(F.array_join(F.transform(all_, lambda x: x["document"]), " | ").alias("captions"))


@query
def holdout_index(spark, folder):
    return I.hold_out(caption_index(spark, folder), asked(spark, folder).select(F.col("query_id").alias("image_id"))).select("id", "image_id", "ann_id", "document")


@query
def holdout_counts(spark, folder):
    before = caption_index(spark, folder).agg(F.count(F.lit(1)).alias("before"))
    after = holdout_index(spark, folder).agg(F.count(F.lit(1)).alias("after"))
    return before.join(F.broadcast(after)).withColumn("deleted", F.col("before") - F.col("after"))


def _narrow(spark, folder):
    return caption_index(spark, folder).select("id", "image_id", F.md5("document").alias("digest"))


def _revised(spark, folder):
    """The index as a keyed table: built twice, a third of its rows changed, and every tenth image's rows deleted."""
    rows = written(_narrow(spark, folder), "rows")
    t = snapshots.Table(spark, new_path(spark, "index"), rows.schema)
    for _ in range(2):
        t.upsert(rows)
    t.upsert(rows.where("image_id % 3 = 0").withColumn("digest", F.md5("digest")))
    t.delete(rows.where("image_id % 10 = 0").select("id"))
    return t


@query
def index_upsert(spark, folder):
    """The rows as they are at last, without what a view holds out."""
    return _revised(spark, folder).hold_out("asked", asked(spark, folder).select((F.col("query_id") + 1).alias("image_id"))).read()


@query
def index_versions(spark, folder):
    """Rows and ids of each version; every version stays as it was."""
    t, out = _revised(spark, folder), None
    for v in t.versions():
        part = t.snapshot(v).read().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("digest").alias("digests")).select(F.lit(v).alias("version"), "n", "ids", "digests")
        out = part if out is None else out.unionByName(part)
    return out


@query
def vector_norms(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", r(V.norm(F.col("embedding"))).alias("norm"), r(V.normalise(F.col("embedding"))[0]).alias("dim0"))


@query
def pair_scores(spark, folder):
    e = table(spark, folder, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    scored = a.join(b, "vec_id").withColumn("cosine", V.dot(F.col("a"), F.col("b")))
    return scored.select("vec_id", r("cosine").alias("cosine"), r(V.squared_l2(F.col("cosine"))).alias("squared_l2"), r(V.clip_score(F.col("cosine"), F.lit("x"))).alias("clip_score"))


def _found(df):
    return df.select("query_id", "rank", "id", r("distance").alias("distance"))


@query
def knn_top10_sibling_excluded(spark, folder):
    return _found(knn.nearest_captions(asked(spark, folder), caption_index(spark, folder), 10, True, dealt_images(spark, folder)))


@query
def knn_top1(spark, folder):
    return _found(knn.nearest_captions(asked(spark, folder), caption_index(spark, folder), 1, images=dealt_images(spark, folder)))


@query
def knn_id_excluded(spark, folder):
    """Only the query's first row is left out, so its siblings come first, at distance 0."""
    i = caption_index(spark, folder)
    own = i.groupBy(F.col("image_id").alias("query_id")).agg(F.min("ann_id").alias("own"))
    found = knn.nearest_captions(asked(spark, folder), i, 6, images=dealt_images(spark, folder)).join(own, "query_id", "left").where("not (image_id = query_id and ann_id = own)")
    w = Window.partitionBy("query_id").orderBy("rank")
    return _found(found.withColumn("rank", F.row_number().over(w)).where("rank <= 5"))


@query
def confidence_flag(spark, folder):
    top = selection.select_top1(pool(spark, folder, 1))
    return top.select("query_id", V.is_uncertain(F.col("distance"), 1.25).alias("uncertain"), (F.col("caption") == "").alias("empty"))


@query
def select_top1(spark, folder):
    return selection.select_top1(pool(spark, folder, 1)).select("query_id", "caption", r("distance").alias("distance"))


@query
def medoid_caption(spark, folder):
    return selection.select_medoid(pool(spark, folder)).select("query_id", "caption", r("distance").alias("distance"), r("mean_similarity").alias("mean_similarity"))


@query
def match_distance(spark, folder):
    p = pool(spark, folder)
    return selection.match_distance(p, selection.select_medoid(p)).select("query_id", "caption", r("distance").alias("distance"))


@query
def aggregate_captions(spark, folder):
    return selection.choose(pool(spark, folder, 3), "aggregated").select("query_id", "caption")


@query
def aggregate_documents(spark, folder):
    """Sentence-wise aggregation of the whole texts of all documents, one block each."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), F.lit(1).alias("pos"), F.col("text").alias("document"))
    return selection.aggregate_captions(d)


def variants(spark, folder):
    """The image itself and, for its crops, the three vectors that follow."""
    q, e = asked(spark, folder).select("query_id"), table(spark, folder, "embeddings")
    rows = q.withColumn("variant_no", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("vec_id", F.col("query_id") + F.col("variant_no"))
    return rows.join(e, "vec_id").select("query_id", "variant_no", "embedding")


@query
def advanced_retrieve(spark, folder):
    got = retrieve.advanced(variants(spark, folder), caption_index(spark, folder), images=dealt_images(spark, folder))
    return got.select("query_id", "caption", r("distance").alias("distance"), "variants")


def augmented(spark, folder):
    return knn.images_of(caption_index(spark, folder).where("is_augmented"))


@query
def near_dup_pairs(spark, folder):
    return similar.similar_pairs(augmented(spark, folder), TWIN).select("a", "b", r("cosine").alias("cosine"))


@query
def max_sim_partner(spark, folder):
    return similar.best_partners(augmented(spark, folder), TWIN).select("image_id", "partner", r("cosine").alias("cosine"))


@query
def near_dup_clusters(spark, folder):
    return graph.clusters(similar.similar_links(augmented(spark, folder), TWIN))


@query
def near_dup_links(spark, folder):
    """One row an image: its cluster, and how many others are similar to it."""
    return similar.similar_classes(augmented(spark, folder), TWIN)


@query
def folded_clusters(spark, folder):
    """The clusters again, links coming in three batches."""
    links, f = written(similar.similar_links(augmented(spark, folder), TWIN), "links"), folded.Folded(spark, new_path(spark, "folded"))
    for batch in range(3):
        f.fold(links.where(F.pmod(F.xxhash64("a", "b"), F.lit(3)) == batch))
    return f.labels().select(F.col("node").alias("image_id"), F.col("root").alias("cluster"))


@query
def cluster_stats(spark, folder):
    sizes = graph.cluster_sizes(near_dup_clusters(spark, folder))
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("members"), F.max("size").alias("largest"))


@query
def shift_summary(spark, folder):
    """Nearest distance of four cells: base images, augmented images before, after, and after without twins."""
    i = written(caption_index(spark, folder), "index")
    vectors = written(i.groupBy("image_id").agg(F.first("embedding").alias("embedding"), F.first("is_augmented").alias("is_augmented")), "vectors")
    sample = vectors.where("image_id % 50 = 0").select("image_id", "is_augmented")
    base, aug = sample.where("not is_augmented"), sample.where("is_augmented")
    members = graph.clusters(similar.similar_links(vectors.where("is_augmented"), TWIN))
    twins = graph.twins(aug, members).unionByName(aug.select("image_id")).distinct()
    held_base = I.hold_out(vectors.where("not is_augmented"), base)
    after = I.hold_out(vectors, sample)
    cells = {"base": (base, held_base), "before": (aug, held_base), "after": (aug, after), "after_without_twins": (aug, I.hold_out(after, twins))}
    out = None
    for name, (who, where) in cells.items():
        q = vectors.join(who.select("image_id"), "image_id", "left_semi").select(F.col("image_id").alias("query_id"), "embedding")
        part = knn.top_images(q, where, 1).select(F.lit(name).alias("cell"), (2.0 * (1.0 - F.col("cosine"))).alias("distance"))
        out = part if out is None else out.unionByName(part)
    got = diagnostics.summary(written(out, "distances"), ["cell"], "distance")
    return got.select("cell", *[r(c).alias(c) for c in ("mean", "median", "least", "most")], "n")


@query
def recall_unheld(spark, folder):
    q = asked(spark, folder)
    hits = diagnostics.first_hits(knn.nearest_captions(q, caption_index(spark, folder), 10, images=dealt_images(spark, folder)))
    return diagnostics.recall_at(hits, q, (1, 5, 10))


@query
def recall_heldout(spark, folder):
    q, i = asked(spark, folder), caption_index(spark, folder)
    held = I.hold_out(i, q.select(F.col("query_id").alias("image_id")))
    return diagnostics.recall_at(diagnostics.first_hits(knn.nearest_captions(q, held, 10)), q, (1, 5, 10))


@query
def first_hit_rank(spark, folder):
    return diagnostics.first_hits(knn.nearest_captions(asked(spark, folder), caption_index(spark, folder), 10, images=dealt_images(spark, folder)))


def _images(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")


def _ranked(df):
    return df.select("query_id", F.col("image_id").alias("id"), "rank")


@query
def int8_overlap(spark, folder):
    q, i = asked(spark, folder), _images(spark, folder)
    plain = _ranked(knn.top_images(q, i, 10, True))
    coarse = _ranked(knn.top_images(quantize.int8_round_trip(q), quantize.int8_round_trip(i), 10, True, unit=False))
    return quantize.overlap(plain, coarse, 10).select("queries", "shared", r("overlap").alias("overlap"), "flips", r("flip_rate").alias("flip_rate"))


@query
def int8_vectors(spark, folder):
    coded = quantize.int8_round_trip(_images(spark, folder))
    return coded.select("image_id", r("scale").alias("scale"), F.array_join(F.transform("codes", lambda x: x.cast("string")), " ").alias("codes"))


@query
def fp16_overlap(spark, folder):
    q, i = asked(spark, folder), _images(spark, folder)
    plain = _ranked(knn.top_images(q, i, 10, True))
    half = _ranked(knn.top_images(quantize.fp16_round_trip(q), quantize.fp16_round_trip(i), 10, True, unit=False))
    return quantize.overlap(plain, half, 10).select("queries", "shared", r("overlap").alias("overlap"), "flips", r("flip_rate").alias("flip_rate"))


@query
def memory_table(spark, folder):
    return quantize.memory_table(_images(spark, folder))


def _scored(spark, folder):
    i = caption_index(spark, folder)
    cand = selection.select_medoid(pool(spark, folder)).select(F.col("query_id").alias("item"), F.col("caption").alias("candidate"))
    return cand, i.select(F.col("image_id").alias("item"), F.col("document").alias("reference"))


@query
def bleu4(spark, folder):
    return metrics.bleu(*_scored(spark, folder)).select(r("bleu").alias("bleu"), "n")


@query
def bleu1(spark, folder):
    return metrics.bleu(*_scored(spark, folder), most=1).select(r("bleu").alias("bleu"), "n")


@query
def cider(spark, folder):
    return metrics.cider(*_scored(spark, folder)).select("item", r("cider").alias("cider"))


@query
def cider_stored(spark, folder):
    """CIDEr by document frequencies that were counted before, in two parts."""
    cand, refs = _scored(spark, folder)
    cand = written(cand, "medoids")
    mine = written(refs.join(cand.select("item"), "item", "left_semi"), "references")
    parts = [metrics.gram_frequencies(mine.where(F.col("item") % 100 == part)) for part in (0, 50)]
    stored = written(metrics.merged_frequencies(*parts), "frequencies")
    return metrics.cider(cand, mine, frequencies=stored).select("item", r("cider").alias("cider"))


@query
def caption_space(spark, folder):
    """Where the images of held-out captions come among each other by the captions' vectors, fitted to all other captions."""
    i, images = caption_index(spark, folder).select("id", "image_id", "document"), dealt_images(spark, folder)
    held = F.col("image_id") % 50 == 0
    space = spaces.fit(i.where(~held), images.where(~held))
    return spaces.own_rank(space, i.where(held), images.where(held)).select("image_id", F.md5("document").alias("caption"), "rank", "of")


@query
def rouge_l(spark, folder):
    return metrics.rouge_l(*_scored(spark, folder)).select("item", r("rouge_l").alias("rouge_l"))


@query
def meteor_exact(spark, folder):
    return metrics.meteor_exact(*_scored(spark, folder)).select("item", r("meteor_exact").alias("meteor_exact"))


@query
def metric_delta(spark, folder):
    """CIDEr of the medoid against that of the nearest caption."""
    cand, refs = _scored(spark, folder)
    near = selection.select_top1(pool(spark, folder, 1)).select(F.col("query_id").alias("item"), F.col("caption").alias("candidate"))
    mean = lambda c, name: metrics.cider(c, refs).agg(F.avg("cider").alias(name))
    both = mean(cand, "medoid").join(F.broadcast(mean(near, "top1")))
    return both.select(r("medoid").alias("medoid"), r("top1").alias("top1"), r(F.col("medoid") - F.col("top1")).alias("delta"))


@query
def clip_score(spark, folder):
    top = knn.nearest_captions(asked(spark, folder), caption_index(spark, folder), 1, True, dealt_images(spark, folder))
    return top.select("query_id", r(V.clip_score(1.0 - F.col("distance") / 2, F.col("document"))).alias("clip_score"))


def said(text):
    """The vector of a text's words, in place of a text encoder's."""
    return V.hashed_words(T.tokens(text), 64)


def said_by_each(texts, dims: int = 64):
    """(document, embedding) of distinct ``texts`` (document), as :func:`said` makes it: words are counted as rows, so a
    long text costs its words and not its words times ``dims``."""
    keyed = texts.distinct().withColumn("__key", F.sha2("document", 256))
    words = keyed.select("__key", F.explode(T.tokens(F.col("document"))).alias("word")).groupBy("__key", "word").agg(F.count(F.lit(1)).alias("n"))
    h = F.md5("word")
    marks = words.select("__key", F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int").alias("at"), F.when(F.substring(h, 9, 1) < "8", F.col("n")).otherwise(-F.col("n")).alias("n"))
    places = marks.groupBy("__key", "at").agg(F.sum("n").cast("double").alias("v")).groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))  # dims entries at most
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return keyed.join(places, "__key", "left").select("document", vector.alias("embedding"))


@query
def generic_floor(spark, folder):
    """What one caption for all images scores against each of them."""
    floor = spark.range(1).select(F.lit(retrieve.FLOOR).alias("caption"), V.normalise(said(F.lit(retrieve.FLOOR))).alias("floor"))
    scored = V.clip_score(V.dot(V.normalise(F.col("embedding")), F.col("floor")), F.col("caption"))
    return _images(spark, folder).join(F.broadcast(floor)).select("image_id", "caption", r(scored).alias("clip_score"))  # one row


@query
def medoid_vectors(spark, folder):
    """The medoid by vectors of the candidates' texts."""
    p = pool(spark, folder)
    got = selection.select_medoid(p, said_by_each(p.select("document")))
    return got.select("query_id", "caption", r("distance").alias("distance"), r("mean_similarity").alias("mean_similarity"))


@query
def probe_distances(spark, folder):
    got = diagnostics.probe(pool(spark, folder))
    return got.select("query_id", r("top1_distance").alias("top1_distance"), "top1_caption", r("mean_topk_distance").alias("mean_topk_distance"))


@query
def mean_siblings(spark, folder):
    return diagnostics.mean_siblings(caption_index(spark, folder), asked(spark, folder)).select("queries", r("mean_excluded").alias("mean_excluded"))


@query
def median_first_hit(spark, folder):
    return diagnostics.median_first_hit(first_hit_rank(spark, folder))


@query
def further_twins(spark, folder):
    vectors = augmented(spark, folder)
    return graph.further_twins(vectors.where("image_id % 50 = 0"), graph.clusters(similar.similar_links(vectors, TWIN)))


@query
def tie_ranks(spark, folder):
    """How many of the ten nearest images are as near as the first."""
    return diagnostics.tie_ranks(knn.top_images(asked(spark, folder), _images(spark, folder), 10, True))


@query
def approximate_recall(spark, folder):
    """Whether a search of 24 of 32 lists finds nine of the ten nearest images, of all queries; and how many those are."""
    i, q = _images(spark, folder), asked(spark, folder)
    exact = written(knn.top_images(q, i, 10, True), "exact")
    got = approximate.recall(approximate.search(q, approximate.index_of(i, 32), 10, 24, True), exact)
    return got.join(F.broadcast(exact.agg(F.count(F.lit(1)).alias("nearest"), F.sum("image_id").alias("ids")))).select("queries", "nearest", "ids", (F.col("recall") >= 0.9).alias("reached"))


@query
def pq_neighbours(spark, folder):
    """The ten nearest images by bounds of quantised vectors."""
    i, q = _images(spark, folder), asked(spark, folder)
    return pq.exact_search(q, i, pq.build(i, lists=32), 10, exclude_self=True).select("query_id", "rank", "image_id", r("cosine").alias("cosine"))


@query
def scrape_ingest(spark, folder):
    """Pages as a service's files: the first of each url that can be a photograph, numbered by category and place."""
    p = _titles(spark, folder).withColumn("place", F.col("page_id"))
    listed = p.select((F.col("page_id") % 7).alias("category"), F.concat(F.lit("kind "), (F.col("page_id") % 7).cast("string")).alias("phrase"), "place", F.concat(F.lit("file "), F.col("page_id").cast("string")).alias("title"))
    told = p.select(F.concat(F.lit("file "), F.col("page_id").cast("string")).alias("title"), F.when(F.col("page_id") % 5 == 0, "image/gif").otherwise("image/jpeg").alias("mime"),
                    (F.col("page_id") % 900).cast("int").alias("width"), F.lit(300).alias("height"), F.concat(F.lit("u"), (F.col("page_id") % 101).cast("string")).alias("url"), F.col("title").alias("description"),
                    *[F.lit(None).cast("string").alias(c) for c in ("artist", "licence", "licence_url", "page_url")])
    return ingest.scraped(listed, told, ["category", "place"], 100_000_000, 60)[0]


@query
def latency_percentiles(spark, folder):
    return diagnostics.percentiles(table(spark, folder, "events"), "event_type", "value")


@query
def stage_latency(spark, folder):
    got = diagnostics.summary(table(spark, folder, "events"), ["event_type"], "value")
    return got.select("event_type", r("mean", 2).alias("mean_ms"), r("median", 2).alias("p50_ms"), F.col("n").alias("calls"))


def _titles(spark, folder):
    return table(spark, folder, "pages").select("page_id", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query
def clean_description(spark, folder):
    return _titles(spark, folder).select("page_id", T.clean_description(F.col("html")).alias("description"), T.clean_description(F.col("title")).alias("title_description"))


@query
def blocklist_filter(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", T.is_blocked(F.col("text")).alias("text_blocked"), T.is_blocked(F.concat(F.lit("Flag of "), "lang")).alias("title_blocked"))
    return d


@query
def fallback_caption(spark, folder):
    rows = _titles(spark, folder).select("page_id", F.col("title").alias("html"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("phrase"))
    return ingest.captioned(rows).select("page_id", "caption")


@query
def prompts(spark, folder):
    d = table(spark, folder, "documents").withColumn("prompt", T.prompt(F.col("text")))
    return d.select("doc_id", "prompt", T.without_prompt(F.concat(F.translate("prompt", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("  a street ")), F.col("prompt")).alias("stripped"))


def _shards(spark, folder, by):
    return caption_index(spark, folder).select((F.col(by) % 3).cast("int").alias("file_no"), "image_id", "ann_id", F.col("document").alias("caption"))


@query
def merge_annotations(spark, folder):
    rows = _shards(spark, folder, "image_id")
    return ingest.merge([rows.where(F.col("file_no") == i).drop("file_no") for i in range(3)])


@query
def merge_collisions(spark, folder):
    return ingest.collisions(_shards(spark, folder, "ann_id"))


@query
def label_template_join(spark, folder):
    templates = spark.range(10).select(F.col("id").cast("int").alias("label"), F.concat(F.lit("a photo of kind "), F.col("id").cast("string")).alias("caption"))
    rows = ingest.numbered(table(spark, folder, "embeddings").select("vec_id", "label"), ["vec_id"], 90_000_000)
    return ingest.with_templates(rows, templates).select("vec_id", "image_id", F.col("image_id").alias("ann_id"), "caption")


def _boxes(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("image_id"), (F.col("label") + 1).alias("label_id"))
    rows = e.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(6))))
    h = lambda a, m: F.pmod(F.col("image_id") * a + F.col("n") * 97, F.lit(m)).cast("int")
    boxed = rows.withColumn("x0", h(37, 300)).withColumn("y0", h(53, 200)).withColumn("score", h(71, 100) / 100.0)
    return boxed.withColumn("x1", F.col("x0") + h(11, 90) + 5).withColumn("y1", F.col("y0") + h(17, 80) + 5).withColumn("width", F.lit(320)).withColumn("height", F.lit(240))


@query
def crop_boxes(spark, folder):
    return geometry.crop_boxes(_boxes(spark, folder)).select("image_id", "n", "x0", "y0", "x1", "y1")


@query
def top_detections(spark, folder):
    return geometry.top_detections(_boxes(spark, folder)).select("image_id", "place", "label_id", "x0", "y0", "x1", "y1")


@query
def mask_bbox(spark, folder):
    pixels = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 50).alias("image_id"), (F.col("l_linenumber") - 1).alias("seg_id"), (F.col("l_partkey") % 640).alias("x"), (F.col("l_suppkey") % 480).alias("y"))
    return geometry.mask_boxes(pixels)


@query
def top_segments(spark, folder):
    return geometry.top_segments(mask_bbox(spark, folder)).select("image_id", "seg_id", "area", "place")


@query
def random_crops(spark, folder):
    return geometry.random_boxes(_images(spark, folder).select("image_id", F.lit(640).alias("width"), F.lit(480).alias("height")))


def _runs(spark, folder):
    p = pool(spark, folder)
    made = lambda df, name: df.select(F.lit(name).alias("config"), F.col("query_id").alias("image_id"), "caption", r("distance").alias("score"))
    return made(selection.select_top1(p), "top1__none").unionByName(made(selection.select_medoid(p), "medoid__none"))


@query
def gallery_entries(spark, folder):
    refs = caption_index(spark, folder).select("image_id", "ann_id", F.col("document").alias("caption"))
    got = ingest.gallery(_runs(spark, folder), refs)
    return got.select("image_id", F.coalesce(F.array_join("references", " | "), F.lit("")).alias("refs"), F.element_at("configs", "medoid__none")["caption"].alias("medoid"), F.element_at("configs", "top1__none")["caption"].alias("top1"))


#: What stands for the crops of an image: variants 1 and 2 for segments, 3 for an object, the last two for random crops.
KINDS = "case variant_no when 0 then array('original') when 1 then array('segment') when 2 then array('segment', 'random') else array('object', 'random') end"


def _cropped_pool(spark, folder):
    found = retrieve.variant_pool(variants(spark, folder), caption_index(spark, folder), images=dealt_images(spark, folder))
    return written(found, "pool").withColumn("kind", F.explode(F.expr(KINDS)))


@query
def gallery_grid(spark, folder):
    """The whole gallery: two modes and four crop configurations of every image."""
    runs = retrieve.ablation(_cropped_pool(spark, folder), ("none", "segmentation", "object-detection", "both"), ("top1", "medoid"))
    runs = runs.select(F.concat_ws("__", "mode", "crops").alias("config"), F.col("query_id").alias("image_id"), "caption", r("distance").alias("score"))
    refs = caption_index(spark, folder).select("image_id", "ann_id", F.col("document").alias("caption"))
    got = ingest.gallery(written(runs, "runs"), refs)
    said = F.transform(F.array_sort(F.map_entries("configs")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["caption"]))
    return got.select("image_id", F.size("configs").alias("n"), F.md5(F.array_join(said, " ## ")).alias("captions"), F.coalesce(F.array_join("references", " | "), F.lit("")).alias("refs"))


@query
def ablation_table(spark, folder):
    p, v = pool(spark, folder), retrieve.variant_pool(variants(spark, folder), caption_index(spark, folder), images=dealt_images(spark, folder))
    out = None
    for crops, candidates in (("none", p), ("both", v)):
        for mode in ("top1", "medoid"):
            part = selection.choose(candidates, mode).withColumn("crops", F.lit(crops))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("mode", "crops").agg(F.count(F.lit(1)).alias("n"), r(F.avg("distance")).alias("mean_distance"), r(F.avg(F.char_length("caption"))).alias("mean_chars"))


@query
def stride_sample(spark, folder):
    return diagnostics.stride_sample(_images(spark, folder).select("image_id"), "image_id", 50)


@query
def hash_sample(spark, folder):
    return diagnostics.hash_sample(_images(spark, folder).select("image_id"), "image_id", 50)


@query
def tie_census(spark, folder):
    found = knn.nearest_captions(asked(spark, folder), caption_index(spark, folder), 2, True, dealt_images(spark, folder))
    two = found.groupBy("query_id").agg(r(F.max("distance") - F.min("distance"), 9).alias("gap"), F.count(F.lit(1)).alias("n"))
    return two.agg(F.count_if((F.col("n") == 2) & (F.col("gap") == 0)).alias("ties"), F.count(F.lit(1)).alias("queries"))


@query
def k_dependence(spark, folder):
    """Queries whose first row is another if three are asked for: none."""
    q, i, images = asked(spark, folder), caption_index(spark, folder), dealt_images(spark, folder)
    one, three = (knn.nearest_captions(q, i, k, True, images).where("rank = 1").select("query_id", F.col("id").alias(f"k{k}")) for k in (1, 3))
    return one.join(three, "query_id").where(~F.col("k1").eqNullSafe(F.col("k3")))


@query
def chain_disagreement(spark, folder):
    """Rows of an image have one vector: how often the first of ten is another if ties go the other way."""
    got = diagnostics.chain_disagreement(knn.nearest_captions(asked(spark, folder), caption_index(spark, folder), 10, True, dealt_images(spark, folder)))
    return got.select("queries", "disagreements", r("share").alias("share"), "deepest")


@query
def source_shift(spark, folder):
    """Base images and three augmented sources, asked in one run of an index that holds none of them."""
    e = table(spark, folder, "embeddings")
    q = asked(spark, folder)
    held = _images(spark, folder).join(e.where("label < 7").select(F.col("vec_id").alias("image_id")), "image_id", "left_semi").join(q.select(F.col("query_id").alias("image_id")), "image_id", "left_anti")
    found = knn.top_images(q, held, 1).select("query_id", (2.0 * (1.0 - F.col("cosine"))).alias("top1_distance"))
    source = F.when(F.col("label") < 7, "base").otherwise(F.concat(F.lit("source "), F.col("label").cast("string")))
    got = diagnostics.source_shift(written(found.join(q.select("query_id", source.alias("source")), "query_id"), "records"), "base")
    return got.select("source", *[r(c).alias(c) for c in ("mean", "median", "least", "most")], "n", r("shift_pct", 3).alias("shift_pct"))


@query
def flip_examples(spark, folder):
    """The first ten queries whose nearest image is another when vectors are bytes."""
    q, i = asked(spark, folder), _images(spark, folder)
    coarse = knn.top_images(quantize.int8_round_trip(q), quantize.int8_round_trip(i), 10, True, unit=False)
    return quantize.flip_examples(_ranked(knn.top_images(q, i, 10, True)), _ranked(coarse))


@query
def near_dup_audit(spark, folder):
    i = caption_index(spark, folder)
    vectors = written(augmented(spark, folder), "augmented")
    sample = i.where("image_id % 50 = 0 and is_augmented").select("image_id")
    got = graph.audit(written(similar.best_partners(vectors, TWIN), "partners"), graph.clusters(similar.similar_links(vectors, TWIN)), sample, near_exact=0.40)
    return got.withColumn("flagged_pct", r("flagged_pct"))


@query
def shift_percent(spark, folder):
    """By how much each cell's mean nearest distance is above that of base images."""
    cells = shift_summary(spark, folder).groupBy().pivot("cell", ["base", "before", "after", "after_without_twins"]).agg(F.first("mean"))
    return cells.select(*[r(diagnostics.percent_shift(F.col(c), F.col("base")), 3).alias(c) for c in ("before", "after", "after_without_twins")])


@query
def recall_random(spark, folder):
    q = asked(spark, folder)
    found = knn.nearest_captions(diagnostics.random_vectors(q.select("query_id"), 64), caption_index(spark, folder), 10, images=dealt_images(spark, folder))
    return diagnostics.recall_at(diagnostics.first_hits(found), q, (1, 5, 10))


@query
def chance_floor(spark, folder):
    return diagnostics.chance_floor(caption_index(spark, folder), 10).select(r("floor").alias("floor"))


@query
def order_mismatches(spark, folder):
    """Rows fetched by id as text and by numbers: how many come in another place."""
    i = caption_index(spark, folder)
    return diagnostics.order_mismatches(i, ["id"], i, ["image_id", "ann_id"])


@query
def raw_candidates(spark, folder):
    return pool(spark, folder).select("query_id", "rank", "document", r("distance").alias("distance"))


@query
def reference_pairs(spark, folder):
    """The first five scored images with their candidate and references: a report of that length."""
    cand, refs = _scored(spark, folder)
    got = cand.join(refs, "item").groupBy("item", "candidate").agg(F.array_join(F.array_sort(F.collect_list("reference")), " | ").alias("references"))
    return got.orderBy("item").limit(5)


@query
def top1_verbatim(spark, folder):
    """The nearest caption as a baseline; it must score as the top1 mode does."""
    refs = _scored(spark, folder)[1]
    near = selection.select_top1(pool(spark, folder, 1)).select(F.col("query_id").alias("item"), F.col("caption").alias("candidate"))
    plain = pool(spark, folder, 1).select(F.col("query_id").alias("item"), F.col("document").alias("candidate"))
    got = diagnostics.disagreement(metrics.cider(near, refs), metrics.cider(plain, refs), "cider")
    return got.select(r("a").alias("a"), r("b").alias("b"), "agree")


@query
def hand_label_scores(spark, folder):
    """Augmented images against their own caption: found among base images, and in the whole index without their own row."""
    i, q = caption_index(spark, folder), asked(spark, folder)
    mine = i.where("is_augmented").select(F.col("image_id").alias("query_id"))
    who = q.join(mine, "query_id", "left_semi")
    top = lambda where, exclude: knn.nearest_captions(who, where, 1, exclude).select(F.col("query_id").alias("item"), F.col("document").alias("candidate"))
    labels = i.where("is_augmented").select(F.col("image_id").alias("item"), F.col("document").alias("reference"))
    got = metrics.compared(top(i.where("not is_augmented"), False), top(i, True), labels)
    return got.select("item", r("before").alias("before"), r("after").alias("after"))


@query
def quantized_downstream(spark, folder):
    """What vectors of half precision do to the nearest caption: flips, and the corpus BLEU of either."""
    q, i = asked(spark, folder), caption_index(spark, folder)
    refs = i.select(F.col("image_id").alias("item"), F.col("document").alias("reference"))
    halves = quantize.fp16_round_trip(_images(spark, folder).join(i.select("image_id"), "image_id", "left_semi"))
    plain = knn.nearest_captions(q, i, 1, True)
    half = knn.nearest_captions(quantize.fp16_round_trip(q), i, 1, True, halves)
    said = lambda df: df.select(F.col("query_id").alias("item"), F.col("document").alias("candidate"))
    flips = quantize.overlap(plain.select("query_id", "id", "rank"), half.select("query_id", "id", "rank"), 1).select("queries", "flips", "flip_rate")
    a, b = (metrics.bleu(said(df), refs, 1).select(F.col("bleu").alias(n)) for df, n in ((plain, "float32"), (half, "float16")))
    return flips.join(F.broadcast(a)).join(F.broadcast(b)).withColumn("delta", F.col("float16") - F.col("float32"))


@query
def metric_table(spark, folder):
    """Means of the per-image scores of the medoid caption."""
    cand, refs = _scored(spark, folder)
    return metrics.table({"cider": metrics.cider(cand, refs), "rouge_l": metrics.rouge_l(cand, refs), "meteor_exact": metrics.meteor_exact(cand, refs)})


@query
def gallery_lookup(spark, folder):
    refs = caption_index(spark, folder).select("image_id", "ann_id", F.col("document").alias("caption"))
    got = ingest.chosen_entry(ingest.gallery(_runs(spark, folder), refs), "medoid", "none")
    return got.select("image_id", "caption", "score")


@query
def ablation_grid(spark, folder):
    """Every crop configuration and selection mode at once."""
    p = _cropped_pool(spark, folder)
    got = retrieve.ablation(p)
    return got.groupBy("crops", "mode").agg(F.count(F.lit(1)).alias("n"), r(F.avg("distance")).alias("mean_distance"), r(F.avg(F.char_length("caption"))).alias("mean_chars"))


@query
def text_near_dups(spark, folder):
    """All documents, whole texts: those with the same word counts, and those whose cosine is 0.95 or more."""
    return near_text.near_texts(table(spark, folder, "documents"))


def _annotations(spark, folder):
    """(image_id, id, caption) of all documents, dealt to images of which the last fifty have no vector."""
    n = table(spark, folder, "embeddings").count()
    return table(spark, folder, "documents").where("doc_id is not null").select(F.pmod("doc_id", F.lit(n + 50)).alias("image_id"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("caption"))


@query
def annotation_scan(spark, folder):
    """Annotation files of 500 rows each, written and read."""
    rows = _annotations(spark, folder).groupBy(F.expr("id div 500").alias("part")).agg(F.collect_list(F.struct("image_id", "id", "caption")).alias("annotations"))
    path = new_path(spark, "annotations")
    rows.write.partitionBy("part").json(path)  # a file is one object
    return I.read_annotations(spark, path)


@query
def built_index(spark, folder):
    """Rows of annotations whose image has a vector."""
    notes = _annotations(spark, folder).select("image_id", F.col("id").alias("ann_id"), "caption")
    images = _images(spark, folder).join(notes.select("image_id"), "image_id", "left_semi")
    got = I.build_index(notes, images)
    return got.select("id", "image_id", "ann_id", "document", r(F.col("embedding")[0].cast("double")).alias("first"))


@query
def bounded_fetch(spark, folder):
    """The first hundred rows of the index by id."""
    return I.bounded(caption_index(spark, folder).select("id", "image_id", F.md5("document").alias("digest")), 100)


@query
def label_shards(spark, folder):
    """Shards that call the label by either name."""
    e, paths = table(spark, folder, "embeddings").select("vec_id", "label"), [new_path(spark, "shard") for _ in range(2)]
    e.where("vec_id % 2 = 0").write.parquet(paths[0])
    e.where("vec_id % 2 = 1").withColumnRenamed("label", "target").write.parquet(paths[1])
    parts = [I.read_label_shards(spark, p).select("vec_id", "label") for p in paths]
    return ingest.with_templates(parts[0].unionByName(parts[1]), spark.range(10).select(F.col("id").cast("int").alias("label"), F.format_string("a photo of kind %d", "id").alias("caption")))


@query
def hand_labels(spark, folder):
    """Hand labels of the asked images, as one small JSON object, written and read."""
    path = new_path(spark, "labels")
    few = asked(spark, folder).groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("query_id").cast("string"), F.concat(F.lit("label "), F.col("label").cast("string")))))).alias("value"))
    few.write.text(path)
    return I.read_hand_labels(spark, path)


@query
def prior_results(spark, folder):
    """A report of an earlier run, written and read: its sample can be asked again."""
    p, path = pool(spark, folder), new_path(spark, "report")
    records = diagnostics.probe(p).select(F.concat(F.col("query_id").cast("string"), F.lit(".jpg")).alias("file"), "top1_distance", F.md5("top1_caption").alias("top1_caption"), "mean_topk_distance")
    I.write_nested(records, path, index=I.stats(caption_index(spark, folder), "captions"))
    got = I.read_results(spark, path, {"base": "records"})
    return got.select("sample", "image_id", r("top1_distance").alias("top1_distance"), "top1_caption", r("mean_topk_distance").alias("mean_topk_distance"))


@query
def attribution_lines(spark, folder):
    """A line of JSON for each page, with nulls."""
    path = new_path(spark, "notes")
    notes = _titles(spark, folder).select(F.col("page_id").alias("image_id"), T.title_without_prefix(F.concat(F.when(F.col("page_id") % 2 == 0, "Category:").otherwise(""), F.col("title"))).alias("title"), F.when(F.col("page_id") % 3 == 0, "CC0").alias("license"))
    I.write_attributions(notes, path)
    return spark.read.schema("image_id bigint, title string, license string").json(path)


@query
def variant_names(spark, folder):
    """The names of each query's variants: the original, then segments and objects by number."""
    kind = F.expr("case variant_no when 0 then 'original' when 3 then 'object' else 'segment' end")
    return retrieve.variant_names(variants(spark, folder).select("query_id", "variant_no", kind.alias("kind")))
