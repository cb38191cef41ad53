"""Crops of images as box arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAD, LEAST_SIDE, LEAST_AREA, MOST, SCORE = 10, 48, 100, 3, 0.3


def padded(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, pad: int = PAD) -> Column:
    zero = F.lit(0)
    return F.struct(F.greatest(zero, x0 - pad).alias("x0"), F.greatest(zero, y0 - pad).alias("y0"), F.least(width, x1 + pad).alias("x1"), F.least(height, y1 + pad).alias("y1"))


def crop_boxes(boxes: DataFrame, pad: int = PAD, least: int = LEAST_SIDE) -> DataFrame:
    """Boxes (x0, y0, x1, y1) padded and clipped to (width, height); those with a side under ``least`` go."""
    got = boxes.withColumn("box", padded(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("width"), F.col("height"), pad))
    keep = got.where((F.col("box.x1") - F.col("box.x0") >= least) & (F.col("box.y1") - F.col("box.y0") >= least))
    return keep.select(*[c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")], "box.*")


def mask_boxes(pixels: DataFrame, least_area: int = LEAST_AREA) -> DataFrame:
    """(image_id, seg_id, area, x0, y0, x1, y1) of pixel rows; the far edge is the last pixel."""
    got = pixels.where("seg_id > 0").groupBy("image_id", "seg_id").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return got.where(F.col("area") >= least_area)


def top_segments(segments: DataFrame, most: int = MOST, least_area: int = LEAST_AREA) -> DataFrame:
    w = Window.partitionBy("image_id").orderBy(F.desc("area"), "seg_id")
    kept = segments.where((F.col("seg_id") > 0) & (F.col("area") >= least_area))
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def top_detections(found: DataFrame, score: float = SCORE, most: int = MOST, pad: int = PAD, least: int = LEAST_SIDE) -> DataFrame:
    """The best ``most`` detections over ``score``, and of those the ones whose crop is large enough: none is filled in."""
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "label_id", "x0", "y0")
    ranked = found.where(F.col("score") > score).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return crop_boxes(ranked, pad, least)


def random_boxes(images: DataFrame, count: int = 6, low: float = 0.4, high: float = 0.8) -> DataFrame:
    """(image_id, n, x0, y0, x1, y1): ``count`` boxes of 40 to 80 % of each side, from hashes of id and number."""
    rows = images.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(count))))
    u = lambda salt: F.pmod(F.xxhash64(F.col("image_id"), F.col("n"), F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0
    side = lambda c, s: F.floor(F.col(c) * (low + (high - low) * u(s))).cast("int")
    sized = rows.withColumn("w", side("width", 1)).withColumn("h", side("height", 2))
    at = lambda c, s, k: F.floor((F.col(c) - F.col(s) + 1) * u(k)).cast("int")
    return sized.withColumn("x0", at("width", "w", 3)).withColumn("y0", at("height", "h", 4)).select("image_id", "n", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
