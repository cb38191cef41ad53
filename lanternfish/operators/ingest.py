"""Sources made into annotations: cleaned, filtered, merged, numbered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from lanternfish.functions import text as T
from lanternfish.sources.scratch import written


def collisions(shards: DataFrame) -> DataFrame:
    """(image_id, files) of images in more than one file; ``shards`` has file_no, image_id, ann_id, caption."""
    return shards.select("image_id", "file_no").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("files")).where("files > 1")


def merge(files: list[DataFrame]) -> DataFrame:
    """Union of annotation tables; an image in two of them is an error, repeats within one are not."""
    rows = reduce(DataFrame.unionByName, [f.withColumn("file_no", F.lit(i)) for i, f in enumerate(files)])
    bad = collisions(rows).orderBy("image_id").first()
    if bad:
        raise ValueError(f"image {bad['image_id']} is in more than one file")
    return rows.drop("file_no")


def numbered(rows: DataFrame, order: list[str], offset: int, name: str = "image_id") -> DataFrame:
    """``rows`` with consecutive numbers from ``offset`` in the given order, without one task for all.

    Rows are dealt out in ranges and sorted once, and written with their place: the range and the row in it.
    Both the ranges' sizes and the numbers come from that one table, so they agree however ranges were
    sampled or coalesced. Rows of equal ``order`` go by a hash of their plain columns, which also splits a
    value that many rows share; rows that are equal in all of these are one range.
    """
    plain = [F.col(f"`{f.name}`") for f in rows.schema if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
    by = [*map(F.col, order), F.xxhash64(*plain) if plain else F.lit(0)]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # the number of the task in the high bits, that of the row in the 33 low ones
    placed = written(sorted_.withColumn("__place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # a row a task
    number = F.lit(offset) + F.col("__start") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, number).drop("__part", "__place", "__start")


def with_templates(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """``rows`` (label, ...) with the caption of their label; a label without a template is an error."""
    missing = rows.select("label").distinct().join(templates, "label", "left_anti").first()
    if missing:
        raise ValueError(f"no template for label {missing['label']}")
    return rows.join(templates, "label")


def is_photo(rows: DataFrame, least: int = 200) -> DataFrame:
    """Rows (mime, width, height, url, title) that can be photographs."""
    big = (F.coalesce("width", F.lit(0)) >= least) & (F.coalesce("height", F.lit(0)) >= least)
    return rows.where(F.col("mime").isin("image/jpeg", "image/png") & big & (F.coalesce("url", F.lit("")) != "") & ~T.is_blocked(F.col("title")))


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each value of ``key`` in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def scraped(listed: DataFrame, info: DataFrame, order: list[str], offset: int, target: int, load: DataFrame | None = None,
            seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((image_id, id, caption) of what is taken, (image_id, title, author, license, license_url, source_url, category)).

    ``listed`` is (category, phrase, place, title, ...), ``info`` what the service says of each title. Titles that can be
    photographs are taken in the ``order`` of categories and places, the first of each url, ``target`` at most; with
    ``load`` (title, content) only those whose image came, with ``seen`` (url) none that an earlier run took. Numbers from ``offset`` go to what is taken.
    """
    fit = is_photo(listed.join(info, "title"))
    if load is not None:
        fit = fit.join(load.where("content is not null").select("title").distinct(), "title", "left_semi")
    if seen is not None:
        fit = fit.join(seen.select("url").distinct(), "url", "left_anti")
    first = first_of_each(fit, "url", order)
    taken = numbered(captioned(first.withColumn("html", F.col("description"))), order, 0, "__n").where(F.col("__n") < target)
    taken = written(taken.withColumn("image_id", F.col("__n") + offset).drop("__n"), "taken")
    notes = taken.select("image_id", "title", F.col("artist").alias("author"), F.col("licence").alias("license"), F.col("licence_url").alias("license_url"), F.col("page_url").alias("source_url"), "category")
    return taken.select("image_id", F.col("image_id").alias("id"), "caption"), notes


def labelled_images(shards: DataFrame, templates: DataFrame, order: list[str], offset: int = 90_000_000) -> DataFrame:
    """(image_id, id, caption, content) of rows (label, content, ...) of label shards: numbered in ``order`` from ``offset``
    over all shards, each with the caption of its label; a label without a template is an error."""
    rows = numbered(with_templates(shards, templates), order, offset)
    return rows.select("image_id", F.col("image_id").alias("id"), "caption", "content")


def captioned(rows: DataFrame) -> DataFrame:
    """``rows`` (html, phrase) with description and caption: the clean description, or one made of the phrase."""
    clean = T.clean_description(F.col("html"))
    described = rows.withColumn("description", F.when(~T.is_blocked(clean), clean))
    return described.withColumn("caption", T.fallback_caption(F.col("description"), F.col("phrase")))


def capped(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def categories(direct: DataFrame, nested: DataFrame, most: int) -> DataFrame:
    """(category, title): a category's own titles, then those of its subcategories, each once, at most ``most``."""
    rows = direct.select("category", "title", "pos", F.lit(0).alias("level")).unionByName(nested.select("category", "title", "pos", F.lit(1).alias("level")))
    first = rows.groupBy("category", "title").agg(F.min(F.struct("level", "pos")).alias("at"))
    return capped(first, "category", ["at", "title"], most).select("category", "title")


def gallery(runs: DataFrame, references: DataFrame, shown: int = 3) -> DataFrame:
    """(image_id, references, configs map) of (config, image_id, caption, score); runs of unlike image sets are an error."""
    sets = runs.groupBy("image_id").agg(F.countDistinct("config").alias("n"))
    if sets.agg(F.min("n") != F.max("n")).first()[0]:
        raise ValueError("the runs don't cover the same images")
    few = capped(references.select("image_id", "ann_id", "caption"), "image_id", ["ann_id", "caption"], shown)  # a task sends no more of an image
    refs = few.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ann_id", "caption"))), lambda x: x["caption"]).alias("references"))
    made = runs.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("config", F.struct("caption", "score"))))).alias("configs"))
    return made.join(refs, "image_id", "left")


def chosen_entry(entries: DataFrame, mode: str = "medoid", crops: str = "segmentation") -> DataFrame:
    """(image_id, references, caption, score) of one configuration of a gallery; null where it has none."""
    got = F.try_element_at("configs", F.lit(f"{mode}__{crops}"))
    return entries.select("image_id", "references", got["caption"].alias("caption"), got["score"].alias("score"))
