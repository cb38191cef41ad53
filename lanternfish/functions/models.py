"""Models run in Arrow batches. A model is given as a function that loads it; a task loads it once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a model sees at once.
ROWS = 256
TINY = 1e-8
BOXES = "image_id bigint, label_id int, score double, x0 int, y0 int, x1 int, y1 int, width int, height int"
PIXELS = "image_id bigint, seg_id int, x int, y int"


def encoded(rows: DataFrame, column: str, load: Callable[[], Callable[[list], np.ndarray]] | None, name: str = "embedding", size: int = ROWS) -> DataFrame:
    """``rows`` with ``column`` (texts or images' bytes) replaced by ``name``, a vector of unit length.

    ``load`` makes a function of a list of values to a matrix. A null value has a null vector. Without
    ``load`` this is an error, as there is no model to ask.
    """
    if load is None:
        raise RuntimeError("no encoder is loaded")
    kept = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            for lo in range(0, whole.num_rows, size):
                batch = whole.slice(lo, size)
                values = batch.column(len(kept)).to_pylist()
                some = [v for v in values if v is not None]
                vectors = iter(())
                if some:
                    model = model or load()
                    m = np.asarray(model(some), dtype=np.float64)
                    vectors = iter(m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), TINY, None))
                out = [None if v is None else next(vectors).astype(np.float32).tolist() for v in values]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.list_(pa.float32()))], names=[*kept, name])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, column).mapInArrow(run, f"{kinds}, `{name}` array<float>")


def _found(images: DataFrame, load: Callable | None, enabled: bool, schema: str) -> DataFrame:
    """Rows of ``schema`` that the model makes of each (image_id, content); none, and no model, if not ``enabled``."""
    if not enabled:
        return images.sparkSession.createDataFrame([], schema)
    if load is None:
        raise RuntimeError("no detector is loaded")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            for image, content in zip(frame["image_id"], frame["content"]):
                if content is not None:
                    model = model or load()
                    yield pd.DataFrame([(image, *row) for row in model(content)], columns=names)

    return images.select("image_id", "content").mapInPandas(run, schema)


def detections(images: DataFrame, load: Callable | None = None, enabled: bool = True) -> DataFrame:
    """Boxes of each image, for ``geometry.top_detections``."""
    return _found(images, load, enabled, BOXES)


def segment_pixels(images: DataFrame, load: Callable | None = None, enabled: bool = True) -> DataFrame:
    """Pixels of each image's segments, for ``geometry.mask_boxes``."""
    return _found(images, load, enabled, PIXELS)
