"""Sources: tables, annotation files, frames, detector output and a synthetic match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table read with its schema (no inference pass)."""
    return spark.read.schema(schema).parquet(path)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of annotation JSON files: image, category, x1, y1, x2, y2."""
    raw = spark.read.option("multiLine", True).schema("image string, dimensions struct<width:int,height:int>, categories array<struct<id:int,name:string>>, annotations array<struct<id:long,category_id:int,bbox:array<double>>>").json(path)
    a = raw.select("image", "dimensions", "categories", F.explode("annotations").alias("a"))
    name = F.filter("categories", lambda c: c["id"] == F.col("a.category_id"))
    box = F.col("a.bbox")
    return a.select("image", F.col("a.id").alias("id"), F.col("a.category_id").alias("category_id"), F.get(name, F.lit(0))["name"].alias("category"), box[0].alias("x1"), box[1].alias("y1"), (box[0] + box[2]).alias("x2"), (box[1] + box[3]).alias("y2"))


def yolo_labels(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Label text files: a line is class, centre x, centre y, width, height as shares of the image."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") >= 5)
    n = [F.col("p")[i].cast("double") for i in range(5)]
    return t.select("file", n[0].cast("int").alias("class_id"), ((n[1] - n[3] / 2) * width).alias("x1"), ((n[2] - n[4] / 2) * height).alias("y1"), ((n[1] + n[3] / 2) * width).alias("x2"), ((n[2] + n[4] / 2) * height).alias("y2"))


def match_properties(raw: DataFrame) -> DataFrame:
    """The match dimension of video properties; a frame rate that is not positive counts as 25."""
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(25.0)
    return raw.withColumn("fps", fps).withColumn("duration_s", F.col("frame_count") / F.col("fps"))


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """Exported frames as binary rows; frame_idx is the last number in the file name."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.regexp_extract("path", r"(\d+)\D*$", 1).cast("long").alias("frame_idx"), "path", "length", F.col("content").alias("image"))


def detect(frames: DataFrame, model: Callable, schema: str = schemas.DETECTIONS) -> DataFrame:
    """Runs ``model`` (an iterator of pandas frames to an iterator of detections) where the frames are."""
    return frames.mapInPandas(model, schema)


def synthetic_match(spark: SparkSession, frames: int = 750, fps: float = 25.0) -> DataFrame:
    """Positions of ten players a side on closed curves, by column functions alone."""
    base = spark.range(frames).withColumnRenamed("id", "frame_idx").crossJoin(F.broadcast(spark.range(20).withColumnRenamed("id", "det_idx")))
    t, p = F.col("frame_idx") / fps, F.col("det_idx").cast("double")
    team = (F.col("det_idx") % 2).cast("int")
    x = 52.5 + (p - 9.5) * 4.0 + 6.0 * F.sin(0.25 * t + p)
    y = 34.0 + 2.6 * (p % 10 - 4.5) + 4.0 * F.cos(0.2 * t + 1.7 * p)
    return base.select(F.lit(0).cast("long").alias("match_id"), "frame_idx", "det_idx", F.col("det_idx").alias("track_id"), x.alias("x_m"), y.alias("y_m"), team.alias("role_id"), team.cast("long").alias("team_id"))


def synthetic_ball(spark: SparkSession, frames: int = 750, fps: float = 25.0) -> DataFrame:
    """A ball that bounces between the touch lines."""
    t = F.col("id") / fps
    bounce = lambda v, n: F.abs(F.pmod(v, F.lit(2 * n)) - n)
    return spark.range(frames).select(F.lit(0).cast("long").alias("match_id"), F.col("id").alias("frame_idx"), bounce(9.0 * t, 105.0).alias("x_m"), bounce(5.0 * t + 30, 68.0).alias("y_m"), F.lit(3.6 * (81 + 25) ** 0.5).alias("ball_kmh"))
