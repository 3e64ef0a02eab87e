"""Sinks: JSON summaries, event timelines, Markdown reports, the processed TSV, latest-value tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def json_rows(df: DataFrame, path: str) -> None:
    """A JSON object per row (nested structs and arrays as they are); Spark's commit makes it all or nothing."""
    df.write.mode("overwrite").json(path)


def json_text(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def markdown(report: DataFrame, path: str) -> None:
    report.select("markdown").write.mode("overwrite").text(path)


def processed_tsv(rows: DataFrame, path: str) -> None:
    """The thirteen-column table, tab-separated with a header; JSON columns stay text."""
    rows.drop("match_id").write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path)


def read_processed_tsv(spark, path: str) -> DataFrame:
    types = "frame_id long, image_path string, timestamp_s double, num_players long, ball_detected boolean, team_a_count long, team_b_count long, top_speed_kmh double, team_a_space_control_pct double, team_b_space_control_pct double, bounding_boxes string, player_roles string, player_speeds string"
    df = spark.read.schema(types).option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path)
    return df.withColumns({"bounding_boxes": F.from_json("bounding_boxes", "array<array<double>>"), "player_roles": F.from_json("player_roles", "array<string>"), "player_speeds": F.from_json("player_speeds", "map<string,double>")})


def upsert_latest(path: str, key: str = "match_id", order: str = "frame_idx"):
    """A ``foreachBatch`` function that adds the newest row of each key of a micro-batch under its batch number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        w = W.partitionBy(key).orderBy(F.desc(order))
        newest = batch.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_latest(spark, path: str, key: str = "match_id", order: str = "frame_idx") -> DataFrame:
    df = spark.read.parquet(path).drop("batch")
    w = W.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
