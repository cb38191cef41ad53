"""The caption index: records of (id, image_id, ann_id, embedding, document), read, written and held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.sources.snapshots import Table

SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("image_id", T.LongType()), T.StructField("ann_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("document", T.StringType()),
])
ANNOTATIONS = "annotations array<struct<image_id:bigint,id:bigint,caption:string>>"
#: Images below are of one augmentation source, the others of another.
SUBSET_CUT = 91_000_000


def compose_id(image_id: Column, ann_id: Column) -> Column:
    return F.concat_ws("_", image_id.cast("string"), ann_id.cast("string"))


def image_of(id_: Column) -> Column:
    return F.split_part(id_, F.lit("_"), F.lit(1)).cast("bigint")


def is_augmented(id_: Column) -> Column:
    """Rows whose id repeats its image's number."""
    return id_.rlike(r"^(\d+)_\1$")


def subset(image_id: Column) -> Column:
    return F.when(image_id < SUBSET_CUT, "food").otherwise("commons")


def read_annotations(spark: SparkSession, *paths: str) -> DataFrame:
    """(image_id, ann_id, caption) of annotation files."""
    raw = spark.read.schema(ANNOTATIONS).option("multiLine", True).json(list(paths))
    return raw.select(F.explode("annotations").alias("a")).select("a.image_id", F.col("a.id").alias("ann_id"), "a.caption")


def read_images(spark: SparkSession, folder: str, every_kind: bool = False) -> DataFrame:
    """(image_id, path, content) of a folder of images named by number (``.jpg``), or of every image kind."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    if every_kind:
        return files.where(F.lower(name).rlike(r"\.(jpg|jpeg|png)$")).select("path", "content")  # whoever needs an order sorts paths
    return files.where(name.rlike(r"^\d+\.jpg$")).select(F.regexp_extract(name, r"^(\d+)", 1).cast("bigint").alias("image_id"), "path", "content")


def read_templates(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(label, caption) of a JSON object of label names to captions; ``names`` are the labels' names in the order of their
    numbers, and one without a caption is an error."""
    text = spark.read.text(path, wholetext=True)
    told = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "caption"))
    labels = spark.createDataFrame(list(enumerate(names)), "label int, name string")
    got = labels.join(told, "name", "left").select("label", "name", "caption")
    if missing := [r["name"] for r in got.where("caption is null").orderBy("label").take(20)]:
        raise ValueError(f"no caption for the labels {missing}")
    return got.select("label", "caption")


def read_results(spark: SparkSession, path: str, groups: dict[str, str]) -> DataFrame:
    """(sample, image_id, top1_distance, top1_caption, mean_topk_distance) of an earlier run's report, a JSON object whose
    fields ``groups`` names hold records of the files asked: the same sample can then be asked again."""
    record = "array<struct<file:string,top1_distance:double,top1_caption:string,mean_topk_distance:double>>"
    raw = spark.read.schema(", ".join(f"`{c}` {record}" for c in groups.values())).option("multiLine", True).json(path)
    out = None
    for name, column in groups.items():
        part = raw.select(F.lit(name).alias("sample"), F.explode(F.col(f"`{column}`")).alias("r"))
        part = part.select("sample", F.regexp_extract("r.file", r"^(\d+)", 1).cast("bigint").alias("image_id"), "r.top1_distance", "r.top1_caption", "r.mean_topk_distance")
        out = part if out is None else out.unionByName(part)
    return out


def read_label_shards(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of Parquet shards with their label, whichever of two names it has."""
    df = spark.read.parquet(*paths)
    return df.withColumn("label", F.col("label" if "label" in df.columns else "target"))


def read_hand_labels(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, caption) of a JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "caption")).select(F.col("k").cast("bigint").alias("image_id"), "caption")


def build_index(annotations: DataFrame, embedded: DataFrame) -> DataFrame:
    """The index of captions whose image has an embedding; each image is embedded once, whatever its captions."""
    rows = annotations.join(embedded.select("image_id", F.col("embedding").cast("array<float>")), "image_id")
    return rows.select(compose_id(F.col("image_id"), F.col("ann_id")).alias("id"), "image_id", "ann_id", "embedding", F.col("caption").alias("document"))


def table(spark: SparkSession, path: str) -> Table:
    """The index at ``path``, keyed by id and read by snapshots; an empty one is made if there is none."""
    return Table(spark, path, SCHEMA)


def open_or_create(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the index at ``path`` as they are now; what is committed later doesn't change them."""
    return table(spark, path).snapshot().read()


def upsert(index: DataFrame, path: str) -> int:
    """The version of the index at ``path`` in which the rows of ``index`` are, in place of those that had their ids."""
    return table(index.sparkSession, path).upsert(index)


def stats(index: DataFrame, name: str) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("total_embeddings")).withColumn("collection_name", F.lit(name))


def hold_out(index: DataFrame, images: DataFrame) -> DataFrame:
    """``index`` without every row of ``images`` (image_id); nothing is copied or deleted."""
    return index.join(images.select("image_id").distinct(), "image_id", "left_anti")


def bounded(index: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows by id."""
    return index.orderBy("id").limit(most)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_nested(df: DataFrame, path: str, **facts: DataFrame) -> None:
    """A report of one JSON object: the rows of ``df``, few enough for a report, as ``records``, and each one-row table of ``facts`` as a field."""
    whole = df.agg(F.collect_list(F.struct("*")).alias("records"))
    for name, one in facts.items():
        whole = whole.join(F.broadcast(one.select(F.struct("*").alias(name))))  # one row each
    whole.write.mode("overwrite").json(path)


def write_attributions(notes: DataFrame, path: str) -> None:
    """A JSON line for each image that was taken; nulls are written, as every line has the same fields."""
    notes.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def markdown(rows: list[dict]) -> str:
    """A table of a few result rows, for a report."""
    if not rows:
        return ""
    names = list(rows[0])
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)])
