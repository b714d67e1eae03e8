"""Recordings, regions and traces as views over the driver's relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Image size and frames per file of the stand-in recording.
HEIGHT, WIDTH, FILE_FRAMES = 8, 8, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame: ``frame``, ``movie``, ``frame_in_movie``, ``values`` (column-major pixels)."""
    rows = table(spark, sf_dir, "embeddings")
    frame = F.col("vec_id")
    return rows.select(frame.alias("frame"), F.expr(f"vec_id div {FILE_FRAMES}").alias("movie"), (frame % FILE_FRAMES).alias("frame_in_movie"), F.col("embedding").cast("array<double>").alias("values"))


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame and pixel: the fact table of a recording."""
    return explode_pixels(frames(spark, sf_dir), HEIGHT)


def explode_pixels(rows: DataFrame, height: int) -> DataFrame:
    """Pixels of frame rows, with ``px`` column-major from 0."""
    out = rows.select("frame", "movie", "frame_in_movie", F.posexplode("values").alias("px", "v"))
    return out.withColumn("row_", F.col("px") % height).withColumn("col_", F.expr(f"px div {height}").cast("int"))


def manifest(rows: DataFrame) -> DataFrame:
    """One row per movie file: number of frames, first and last global frame."""
    return rows.groupBy("movie").agg(F.count_distinct("frame").alias("z"), F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"))


def roi_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the regions, with their activity ``act`` (sample deviation over all frames): in each quarter of the image
    the four most active ones are the body of a region and the others its background."""
    act = F.round(F.stddev_samp("v"), 9)
    px = movie(spark, sf_dir).groupBy("px", "row_", "col_").agg(act.alias("act"))
    px = px.withColumn("roi_id", F.expr(f"cast((row_ div {HEIGHT // 2}) * 2 + col_ div {WIDTH // 2} as int)"))
    order = Window.partitionBy("roi_id").orderBy(F.desc("act"), "px")  # a row for each pixel of a quarter
    kind = F.when(F.row_number().over(order) <= 4, "body").otherwise("neuropil")
    return px.select("roi_id", kind.alias("kind"), "px", "act")


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and background coefficient of every region; the latter is its background's mean activity over its body's."""
    mean = {k: F.avg(F.when(F.col("kind") == k, F.col("act"))) for k in ("body", "neuropil")}
    found = roi_pixels(spark, sf_dir).groupBy("roi_id").agg(F.round(mean["neuropil"] / mean["body"], 6).alias("sub_coef"))
    return found.select("roi_id", (F.col("roi_id") % 9 + 1).alias("grp"), "sub_coef")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per user: value by frame number in time order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("roi_id"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("value").alias("f"), "event_type")


def stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frames and targets of stimuli: every frame whose label is another than the frame's before."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key_frame"), F.col("label").alias("target"))
    before = rows.select((F.col("key_frame") + 1).alias("key_frame"), F.col("target").alias("was"), F.lit(True).alias("there"))
    return rows.join(before, "key_frame", "left").where(F.col("there").isNull() | ~F.col("target").eqNullSafe(F.col("was"))).select("key_frame", "target")
