"""Detection in batches, and frames drawn from positions for matches that have no film."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T

WIDTH, HEIGHT = 105, 68
DRAWN_BYTES = 1 << 20  # images that a task draws at once; a batch of rows has thousands of frames
_BOXES = T.StructType([T.StructField("boxes", T.ArrayType(T.FloatType())), T.StructField("n", T.IntegerType())])


def detected(frames: DataFrame, load: Callable, batch_size: int = 16, most: int = 300) -> DataFrame:
    """Boxes (match_id, frame_idx, det_idx, x1, y1, x2, y2, conf, class_id) of grey frames, ``batch_size`` images a call.

    ``load`` makes the model, once in each Python worker; the model maps an
    array (batch, height, width) of bytes to a list with an array of rows
    (x1, y1, x2, y2, conf, class_id) for each image.  Frames of one size go
    together; each keeps its own number, so numbers do not hang on how batches
    fall.  Images of another length than width x height have no boxes.
    """
    sizes = [tuple(r) for r in frames.select("width", "height").distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("frames of one size go together: filter by width and height")
    width, height = sizes[0] if sizes else (1, 1)

    def make():
        model = load()

        def predict(images: np.ndarray) -> list[dict]:
            pixels = np.frombuffer(bytearray().join(images), np.uint8).reshape(-1, height, width)
            found = [np.asarray(b, np.float32).reshape(-1, 6)[:most] for b in model(pixels)]
            return [{"boxes": b.ravel(), "n": len(b)} for b in found]

        return predict

    infer = predict_batch_udf(make, return_type=_BOXES, batch_size=batch_size)
    fit = frames.where(F.octet_length("image") == height * width)
    value = lambda i, k: F.get("f.boxes", i * 6 + k).cast("double")
    box = lambda i: F.struct(i.cast("long").alias("det_idx"), *(value(i, k).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2", "conf"))), value(i, 5).cast("int").alias("class_id"))
    boxes = F.when(F.col("f.n") > 0, F.transform(F.sequence(F.lit(0), F.col("f.n") - 1), box))
    return fit.select("match_id", "frame_idx", infer("image").alias("f")).select("match_id", "frame_idx", F.inline(boxes))


def drawn(positions: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Grey frames of ``positions(match_id, frame_idx, x_m, y_m)``: a bright cell of a metre for each person on the pitch."""
    cell = F.floor("y_m").cast("int") * width + F.floor("x_m").cast("int")
    inside = F.col("x_m").between(0, width - 1e-9) & F.col("y_m").between(0, height - 1e-9)
    per = positions.groupBy("match_id", "frame_idx").agg(F.collect_set(F.when(inside, cell)).alias("cells"))

    run = lambda batches: images(batches, width, height)
    return per.select(F.col("match_id").cast("long"), F.col("frame_idx").cast("long"), "cells").mapInArrow(run, "match_id long, frame_idx long, width int, height int, image binary")


def images(batches: Iterator[pa.RecordBatch], width: int, height: int) -> Iterator[pa.RecordBatch]:
    """Images of frames (match_id, frame_idx, cells), ``DRAWN_BYTES`` of them at once."""
    at_once = max(1, DRAWN_BYTES // (width * height))
    for batch in batches:
        for i in range(0, batch.num_rows, at_once):
            some, made = batch.slice(i, at_once), []
            for cells in some.column("cells").to_pylist():
                image = np.zeros(width * height, np.uint8)
                image[cells] = 255
                made.append(image.tobytes())
            n = some.num_rows
            yield pa.RecordBatch.from_arrays([some.column("match_id"), some.column("frame_idx"), pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array(made, pa.binary())], ["match_id", "frame_idx", "width", "height", "image"])


def spots():
    """A model that takes each bright cell for a person: stands for a detector where frames are drawn."""

    def model(images: np.ndarray) -> list[np.ndarray]:
        out = []
        for image in images:
            y, x = np.nonzero(image > 127)
            out.append(np.stack([x, y, x + 1, y + 1, image[y, x] / 255.0, np.zeros(len(x))], 1))
        return out

    return model
