"""The engine as one object: set up an index, build it from annotated images, caption images."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions.models import encoded
from lanternfish.functions.text import EMPTY_MESSAGE
from lanternfish.operators import retrieve
from lanternfish.sources import index as I


@dataclass(frozen=True)
class Settings:
    images: str = "images"
    annotations: str = "annotations.json"
    index: str = "caption_index"
    backend: str = "retrieval"
    mode: str = "medoid"
    top_k: int = retrieve.TOP_K


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


class Pipeline:
    """``encoder`` loads a model of images' bytes to vectors; ``crops`` makes (query_id, variant_no, content) of
    (query_id, content), the original being variant 0; ``generator`` is the pandas UDF of ``retrieve.generate``."""

    def __init__(self, spark: SparkSession, settings: Settings = Settings(), encoder: Callable | None = None,
                 crops: Callable[[DataFrame], DataFrame] | None = None, generator: Callable | None = None):
        self.spark, self.settings, self.encoder, self.crops, self.generator = spark, settings, encoder, crops, generator

    def setup(self) -> DataFrame:
        """Open the index, or make an empty one; its statistics."""
        return I.stats(I.open_or_create(self.spark, self.settings.index), self.settings.index.rstrip("/").rsplit("/", 1)[-1])

    def build_index(self) -> bool:
        """Put in a row for each caption whose image is there, in place of one that was there; each image is encoded once. False without data."""
        s = self.settings
        if not (exists(self.spark, s.images) and exists(self.spark, s.annotations)):
            return False
        captions = I.read_annotations(self.spark, s.annotations)
        images = I.read_images(self.spark, s.images).join(captions.select("image_id"), "image_id", "left_semi")
        I.upsert(I.build_index(captions, encoded(images.select("image_id", "content"), "content", self.encoder)), s.index)
        return True

    def caption(self, images: DataFrame, top_k: int | None = None, advanced: bool = True) -> DataFrame:
        """(query_id, caption, distance, mode, backend, generated_caption, ...) of images (query_id, content)."""
        s, index = self.settings, I.open_or_create(self.spark, self.settings.index)
        if advanced:
            cut = self.crops(images) if self.crops else images.withColumn("variant_no", F.lit(0))
            got = retrieve.advanced(encoded(cut.select("query_id", "variant_no", "content"), "content", self.encoder), index, s.mode)
        else:
            got = retrieve.basic(encoded(images.select("query_id", "content"), "content", self.encoder), index, s.mode, top_k or s.top_k)
        return retrieve.generate(got, s.backend, self.generator).withColumn("backend", F.lit(s.backend))

    def caption_image(self, path: str, top_k: int | None = None, advanced: bool = True) -> dict:
        """The one image at ``path``; an empty index gives an empty caption."""
        file = self.spark.read.format("binaryFile").load(path).select(F.lit(0).cast("bigint").alias("query_id"), "content")
        got = self.caption(file, top_k, advanced).first()
        return got.asDict() if got else {"query_id": 0, "caption": "", "distance": None, "backend": self.settings.backend, "generated_caption": "", "message": EMPTY_MESSAGE}
