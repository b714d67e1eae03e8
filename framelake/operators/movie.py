"""Operators on recordings: images, temporal bins, pixel covariance, events, regions.

All are native DataFrame expressions.  Joins are equi-joins on computed keys; a table that is sent to all tasks is
the manifest, the regions or the stimuli, which Spark broadcasts below its own size threshold and shuffles above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions.compat import argmax, nan_to_null, non_negative, pearson

from . import tiles

#: Most offsets of a covariance band that go by joins.
BAND = 40


def mean_image(movie: DataFrame) -> DataFrame:
    """Mean of every pixel of every movie; missing values are skipped."""
    return movie.groupBy("movie", "px").agg(F.avg(nan_to_null(F.col("v"))).alias("mean"))


def mean_reference(images: DataFrame) -> DataFrame:
    """Mean image over movies; a movie without the pixel does not count."""
    return images.groupBy("px").agg(F.avg("mean").alias("mean"))


def bin_frames(movie: DataFrame, n: int, how: str = "sum") -> DataFrame:
    """Tumbling bins of n frames within each movie; a last partial bin is dropped by its count, without a join."""
    keyed = movie.withColumn("bin", F.expr(f"frame_in_movie div {n}"))
    out = keyed.groupBy("movie", "bin", "px").agg(F.count("*").alias("n"), getattr(F, how)("v").alias("v"))
    return out.where(F.col("n") == n).drop("n")


def downsample(movie: DataFrame, files: DataFrame, reference: int, bins: int) -> DataFrame:
    """Bin means with as many frames as make the reference movie that many bins (one at least)."""
    z = files.where(F.col("movie") == reference).first()
    return bin_frames(movie, max(1, (z.z if z else 0) // bins), "avg")


def band_offsets(spark, neighbourhood: int) -> DataFrame:
    """(``dcol``, ``drow``) of the stored half band of a neighbourhood, the pixel itself included."""
    cols = spark.range(neighbourhood).select(F.col("id").cast("int").alias("dcol"))
    offsets = cols.select("dcol", F.explode(F.sequence(F.lit(1 - neighbourhood), F.lit(neighbourhood - 1))).alias("drow"))
    return offsets.where("dcol > 0 or drow >= 0")


def neighbour_pairs(px: Column, neighbourhood: int, height: int, width: int) -> Column:
    """Array of the pixels in the stored half band of ``px``, true (row, column) neighbours only."""
    offsets = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("r")) for c in range(neighbourhood) for r in range(1 - neighbourhood, neighbourhood) if c > 0 or r >= 0])
    row, col = px % height, F.floor(px / height).cast("int")
    inside = F.filter(offsets, lambda o: (row + o["r"] >= 0) & (row + o["r"] < height) & (col + o["c"] < width))
    return F.transform(inside, lambda o: (px + o["r"] + o["c"] * height).cast("int"))


def pixel_covariance(bins: DataFrame, neighbourhood: int, height: int, width: int) -> DataFrame:
    """Population covariance over the bins of each movie, averaged over movies, for neighbouring pixels i <= j.

    A pair's bins are those that both pixels have a number in.  A band of more than ``BAND`` offsets goes by image tiles,
    which send a series a few times instead of once for each offset.
    """
    if neighbourhood * (2 * neighbourhood - 1) - neighbourhood + 1 > BAND:
        return tiles.pixel_covariance(bins, neighbourhood, height, width)
    bins = bins.where("v IS NOT NULL AND NOT isnan(v)")
    left = bins.select("movie", "bin", F.col("px").alias("px_i"), F.col("v").alias("a"), F.explode(neighbour_pairs(F.col("px"), neighbourhood, height, width)).alias("px_j"))
    right = bins.select("movie", "bin", F.col("px").alias("px_j"), F.col("v").alias("b"))
    by_movie = left.join(right, ["movie", "bin", "px_j"]).groupBy("movie", "px_i", "px_j").agg(F.covar_pop("a", "b").alias("cov"))
    return by_movie.groupBy("px_i", "px_j").agg(F.avg("cov").alias("cov"))


def pixel_correlation(covariance: DataFrame) -> DataFrame:
    """Correlation from stored covariances: clipped to [-1, 1], 1 on the diagonal, null beside a constant pixel."""
    variance = covariance.where("px_i = px_j")
    a, b = (variance.select(F.col("px_i").alias(f"px_{s}"), F.col("cov").alias(f"var_{s}")) for s in "ij")
    joined = covariance.join(a, "px_i").join(b, "px_j")
    r = F.try_divide(F.col("cov"), F.sqrt(F.col("var_i") * F.col("var_j")))
    clipped = F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))
    return joined.select("px_i", "px_j", F.when((F.col("px_i") == F.col("px_j")) & r.isNotNull(), F.lit(1.0)).when(r.isNotNull(), clipped).alias("r"))


def activity(correlation: DataFrame) -> DataFrame:
    """Mean and deviation of each pixel's absolute correlations, each over its deviation across pixels, summed."""
    per = correlation.groupBy(F.col("px_i").alias("px")).agg(F.avg(F.abs("r")).alias("m"), F.stddev_samp(F.abs("r")).alias("s"))
    scale = per.agg(F.stddev_samp("m").alias("sm"), F.stddev_samp("s").alias("ss"))
    total = F.coalesce(F.try_divide(F.col("m"), F.col("sm")), F.lit(0.0)) + F.coalesce(F.try_divide(F.col("s"), F.col("ss")), F.lit(0.0))
    return per.crossJoin(F.broadcast(scale)).select("px", total.alias("activity"))


def row_major(px: Column, height: int, width: int) -> Column:
    """Column-major pixel number to row-major, both from 0."""
    return (F.floor(px / height) + (px % height) * width).cast("int")


def neighbourhood_pixels(pixels: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Pixels around each one (``dr``, ``dc``); null outside the image."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    out = pixels.select("px", F.explode(steps).alias("dr")).select("px", "dr", F.explode(steps).alias("dc"))
    row, col = F.col("px") % height + F.col("dr"), F.floor(F.col("px") / height) + F.col("dc")
    inside = (row >= 0) & (row < height) & (col >= 0) & (col < width)
    return out.select("px", "dr", "dc", F.when(inside, (row + col * height).cast("int")).alias("neighbour"))


def deinterleave(frames: DataFrame, slices: int, channels: int, flyback: int = 0) -> DataFrame:
    """Channel, slice and volume of every frame; frames of flyback slices are dropped."""
    step = slices + flyback
    out = frames.withColumns({"channel": F.col("frame") % channels, "slice": F.expr(f"(frame div {channels}) % {step}"), "t": F.expr(f"frame div {channels * step}")})
    return out.where(F.col("slice") < slices)


def frame_to_file(frames: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each global frame: the first whose cumulative end reaches it (as-of join).

    Files and frames meet on the number of the block of frames both fall in, so the join has an equality.
    """
    width = 256
    ends = files.select(F.col("movie").alias("file"), "frame_start", "frame_end", F.explode(F.sequence(F.expr(f"frame_start div {width}"), F.expr(f"frame_end div {width}"))).alias("block"))
    keyed = frames.withColumn("block", F.expr(f"frame div {width}"))
    inside = (F.col("frame") >= F.col("frame_start")) & (F.col("frame") <= F.col("frame_end"))
    return keyed.join(ends, "block").where(inside).select("frame", "file", (F.col("frame") - F.col("frame_start")).alias("frame_in_file"))


def event_window(events: DataFrame, low: int, high: int) -> DataFrame:
    """Every event's frames from ``low`` to ``high`` around its key frame."""
    return events.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("offset")).withColumn("frame", F.col("key_frame") + F.col("offset"))


def event_triggered_mean(movie: DataFrame, events: DataFrame, low: int, high: int) -> DataFrame:
    """Mean over events for each offset and pixel; frames beyond the recording are dropped."""
    joined = movie.join(event_window(events, low, high), "frame")
    return joined.groupBy("offset", "px").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def set_bin_mean(movie: DataFrame, members: DataFrame, reference: DataFrame, subtract_one: bool = False) -> DataFrame:
    """Mean over the distinct frames of each bin, over the reference image; a frame may be in several bins."""
    means = movie.join(members.select("bin", "frame").distinct(), "frame").groupBy("bin", "px").agg(F.avg("v").alias("v"))
    ratio = F.try_divide(F.col("v"), F.col("mean"))
    return means.join(reference, "px").select("bin", "px", (ratio - 1 if subtract_one else ratio).alias("ratio"))


def response_matrix(traces: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """Mean after minus mean before the key frame for each (target, region); negative responses are 0."""
    joined = traces.join(event_window(events, -before, after), "frame")
    pre, post = F.avg(F.when(F.col("offset") < 0, F.col("f"))), F.avg(F.when(F.col("offset") > 0, F.col("f")))
    return joined.groupBy("target", "roi_id").agg(F.greatest(post - pre, F.lit(0.0)).alias("response"))


def region_traces(movie: DataFrame, pixels: DataFrame) -> DataFrame:
    """Body mean, background mean of every region and frame (null where a region has no such pixels)."""
    joined = movie.join(pixels, "px")
    body, around = (F.avg(F.when(F.col("kind") == k, F.col("v"))).alias(n) for k, n in (("body", "raw"), ("neuropil", "neuropil")))
    return joined.groupBy("roi_id", "frame").agg(body, around)


def subtract_background(traces: DataFrame, regions: DataFrame) -> DataFrame:
    """``f`` = body - coefficient * background, or the body where there is no background."""
    f = F.col("raw") - F.coalesce(F.col("sub_coef") * F.col("neuropil"), F.lit(0.0))
    return traces.join(regions.select("roi_id", "sub_coef"), "roi_id").withColumn("f", f)


def edge_columns(movie: DataFrame) -> DataFrame:
    """Blank edge columns: those whose brightness lies below the largest gap of the sorted column profile."""
    profile = movie.groupBy("col_").agg(F.avg("v").alias("m"))
    order = Window.orderBy("m", "col_")  # one row for each image column
    gaps = profile.withColumn("gap", F.col("m") - F.lag("m").over(order)).withColumn("k", F.row_number().over(order))
    cut = gaps.agg(argmax(F.coalesce("gap", F.lit(-1.0)), F.col("k")).alias("cut"))
    return gaps.crossJoin(F.broadcast(cut)).where("k < cut").select("col_")


def edge_signal(movie: DataFrame, columns: DataFrame) -> DataFrame:
    """Mean over the edge columns for each row and frame."""
    return movie.join(columns, "col_").groupBy("row_", "frame").agg(F.avg("v").alias("edge"))


def edge_subtracted(movie: DataFrame, pixels: DataFrame, edge: DataFrame) -> DataFrame:
    """Body traces after the edge signal of each pixel's row is taken off."""
    own = movie.join(pixels.where("kind = 'body'"), "px").join(edge, ["row_", "frame"])
    return own.groupBy("roi_id", "frame").agg(F.avg(F.col("v") - F.col("edge")).alias("f"))


def edge_neuropil_subtracted(movie: DataFrame, pixels: DataFrame, edge: DataFrame, rois: DataFrame) -> DataFrame:
    """``raw``, ``neuropil`` and ``f`` of every region, each pixel's row edge signal taken off both; a region without
    background pixels has its raw trace for ``f``."""
    own = movie.join(pixels, "px").join(edge, ["row_", "frame"]).withColumn("off", F.col("v") - F.col("edge"))
    sides = [F.avg(F.when(F.col("kind") == kind, F.col("off"))).alias(name) for kind, name in (("body", "raw"), ("neuropil", "neuropil"))]
    both = own.groupBy("roi_id", "frame").agg(*sides).join(rois.select("roi_id", "sub_coef"), "roi_id")
    return both.select("roi_id", "frame", "raw", "neuropil", (F.col("raw") - F.coalesce(F.col("neuropil") * F.col("sub_coef"), F.lit(0.0))).alias("f"))


def central_sides(height: int, width: int, percent: int = 15) -> tuple[int, int]:
    """Rows and columns to cut off on each side, an even number of them, so that odd lines stay odd."""
    return tuple(2 * (-(-percent * n // 100) // 2) for n in (height, width))


def central_crop(rows: DataFrame, height: int, width: int, percent: int = 15) -> DataFrame:
    """Pixels of the central part of the image: an even number of lines and columns is cut off on every side."""
    top, side = central_sides(height, width, percent)
    return rows.where((F.col("row_") >= top) & (F.col("row_") < height - top) & (F.col("col_") >= side) & (F.col("col_") < width - side))


def side_trim(rows: DataFrame, width: int, share: float = 0.1) -> DataFrame:
    """Pixels without the columns, counted from 1, below ``share`` or above 1 - ``share`` of the width."""
    at = F.col("col_") + 1
    return rows.where((at >= share * width) & (at <= (1 - share) * width))


def clip_blank(rows: DataFrame, width: int, first: float = 50 / 512, last: float = 470 / 512) -> DataFrame:
    """Pixels between the blank edges that old scanners leave: columns, counted from 1, of these shares of the width."""
    at = F.col("col_") + 1
    return rows.where((at >= round(first * width)) & (at <= round(last * width)))


def line_shift_scores(image: DataFrame, height: int, width: int, most: int = 3) -> DataFrame:
    """Correlation of odd lines with even lines shifted along the line, on the central part of a mean image (of each movie
    where the image has a ``movie``)."""
    key = ["movie"] if "movie" in image.columns else []
    _, side = central_sides(height, width)
    n = width - 2 * side
    inner = central_crop(image, height, width).select(*key, "row_", (F.col("col_") - side).alias("c"), "mean")
    odd = inner.where(F.col("row_") % 2 == 0).select(*key, "row_", "c", F.col("mean").alias("a"))
    even = inner.where(F.col("row_") % 2 == 1).select(*key, (F.col("row_") - 1).alias("row_"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift"), F.col("c").alias("c0"), F.col("mean").alias("b"))
    even = even.withColumn("c", F.pmod(F.col("c0") + F.col("shift"), F.lit(n)))
    return odd.join(even, [*key, "row_", "c"]).groupBy(*key, "shift").agg(pearson(F.col("a"), F.col("b")).alias("score"))


def circular_shift(movie: DataFrame, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """Every frame shifted with wraparound."""
    row, col = F.pmod(F.col("row_") + rows, F.lit(height)), F.pmod(F.col("col_") + cols, F.lit(width))
    return movie.select("frame", (row + col * height).cast("int").alias("px"), "v")


def latest_label(pixels: DataFrame) -> DataFrame:
    """Label image: where regions overlap the later id wins."""
    return pixels.groupBy("px").agg(F.max("roi_id").alias("label"))


def centroids(pixels: DataFrame, height: int) -> DataFrame:
    """Rounded mean row and column of every region's body."""
    body = pixels.where("kind = 'body'")
    return body.groupBy("roi_id").agg(F.round(F.avg(F.col("px") % height)).cast("int").alias("row_"), F.round(F.avg(F.floor(F.col("px") / height))).cast("int").alias("col_"))


def boundary(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels of a mask with a side neighbour outside it (or outside the image)."""
    sides = neighbourhood_pixels(pixels.select("px").distinct(), 1, height, width).where("abs(dr) + abs(dc) = 1")
    mask = pixels.select("roi_id", "px").distinct()
    around = mask.join(sides, "px").select("roi_id", "px", "neighbour")
    inside = mask.select("roi_id", F.col("px").alias("neighbour"), F.lit(1).alias("own"))
    return around.join(inside, ["roi_id", "neighbour"], "left").where("own is null").select("roi_id", "px").distinct()


def frame_totals(files: DataFrame) -> DataFrame:
    """Cumulative end of each file in list order."""
    order = Window.orderBy("movie").rowsBetween(Window.unboundedPreceding, 0)  # one row for each file
    return files.select("movie", "z", F.sum("z").over(order).alias("frames_so_far"))


def sync_totals(files: DataFrame) -> DataFrame:
    """(``block``, ``slice``, ``slice_frames``, ``valid_frames``) of a recording's files (``block``, ``movie``, ``slice``, ``z``).

    ``slice_frames`` are a slice's frames up to the last file of a block, by the files' order, whichever block they are of;
    ``valid_frames`` of a block are the least increment over its slices since the block before, times slices + 1 when the
    recording has several slices.  One row for each file and slice, so windows are small.
    """
    order = Window.partitionBy("slice").orderBy("movie").rowsBetween(Window.unboundedPreceding, 0)
    so_far = files.withColumn("so_far", F.sum("z").over(order))
    ends = so_far.groupBy("block", "slice").agg(F.max_by("so_far", "movie").alias("slice_frames"))
    step = F.col("slice_frames") - F.coalesce(F.lag("slice_frames").over(Window.partitionBy("slice").orderBy("block")), F.lit(0))
    steps = ends.withColumn("step", step)
    slices = files.agg(F.count_distinct("slice").alias("slices"))
    valid = steps.groupBy("block").agg(F.min("step").alias("least")).crossJoin(F.broadcast(slices))  # one row
    valid = valid.select("block", (F.col("least") * F.when(F.col("slices") > 1, F.col("slices") + 1).otherwise(1)).alias("valid_frames"))
    return ends.join(valid, "block").select("block", "slice", "slice_frames", "valid_frames")


def synchronised_frames(frames: DataFrame, totals: DataFrame) -> DataFrame:
    """Frames (``slice``, ``frame`` counted within their slice) that all slices of their block have, with their ``block``: a
    block's frames are those after the slice frames of the block before, and the least count over slices is kept."""
    slices = F.count("*").over(Window.partitionBy("block"))
    low = F.coalesce(F.lag("slice_frames").over(Window.partitionBy("slice").orderBy("block")), F.lit(0))
    kept = F.col("valid_frames") / F.when(slices > 1, slices + 1).otherwise(1)
    spans = totals.select("block", "slice", low.alias("low"), F.least(F.col("slice_frames"), low + kept).cast("long").alias("high"))
    # A span meets its frames by their hundreds, so this is an equi-join.
    dealt = spans.where("high > low").select("*", F.explode(F.expr("sequence(low div 100, (high - 1) div 100)")).alias("part"))
    keyed = frames.withColumn("part", F.expr("frame div 100"))
    return keyed.join(dealt, ["slice", "part"]).where("frame >= low AND frame < high").drop("part", "low", "high")


def sync_info(counts: DataFrame) -> DataFrame:
    """Per block the valid frames: the least over slices, times slices + 1 when there are several."""
    k = F.count("*")
    return counts.groupBy("block").agg((F.min("n_frames") * F.when(k > 1, k + 1).otherwise(1)).alias("valid_frames"))


def display_intensity(v: Column, how: str = "sqrt") -> Column:
    """Intensity for registration or display: negatives and missing values as 0, then ``sqrt`` or the ``gamma`` of 1/4."""
    clean = non_negative(v)
    return F.sqrt(clean) if how == "sqrt" else F.pow(clean, F.lit(0.25))


def unit_scale(image: DataFrame, column: str) -> DataFrame:
    """An image (``px``, value) from its least to its greatest value onto 0 to 1; null for a constant image."""
    ends = image.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    scaled = F.try_divide(F.col(column) - F.col("low"), F.col("high") - F.col("low"))
    return image.crossJoin(F.broadcast(ends)).withColumn(column, scaled).drop("low", "high")  # one row of ends


def overview(anatomy: DataFrame, activity: DataFrame) -> DataFrame:
    """Colour composite (``px``, ``red``, ``green``, ``blue``): red has 0.7 anatomy and 0.3 activity, the others anatomy."""
    joined = anatomy.select("px", F.col("v").alias("a")).join(activity.select("px", F.col("v").alias("b")), "px")
    return joined.select("px", (0.7 * F.col("a") + 0.3 * F.col("b")).alias("red"), F.col("a").alias("green"), F.col("a").alias("blue"))


def stimulus_frames(stimuli: DataFrame, blocks: DataFrame, target: int) -> DataFrame:
    """Global frames of one target's stimuli: frame within the block plus the frames of all earlier blocks."""
    order = Window.orderBy("block")  # one row for each block
    starts = blocks.select("block", (F.sum("frames").over(order) - F.col("frames")).alias("start"))
    return stimuli.where(F.col("target") == target).join(starts, "block").select("block", (F.col("start") + F.col("frame")).alias("key_frame"))


def first_trial_frames(trials: DataFrame) -> DataFrame:
    """The first frame of each trial of each target."""
    return trials.groupBy("target", "trial").agg(F.min("frame").alias("key_frame"))


def time_axis(frames: DataFrame, period: float) -> DataFrame:
    """Seconds since the first frame."""
    return frames.withColumn("seconds", F.col("frame") * F.lit(period))


def expand_lines(shifts: DataFrame, most: float = 10.0) -> DataFrame:
    """One row per line of each frame; a line that moves more than ``most`` on either axis does not move at all."""
    lines = shifts.select("movie", "frame", F.posexplode(F.arrays_zip("dy", "dx")).alias("row_", "d"))
    wild = (F.abs("d.dy") > most) | (F.abs("d.dx") > most)
    return lines.select("movie", "frame", "row_", *[F.when(wild, 0.0).otherwise(F.col(f"d.{c}")).alias(c) for c in ("dy", "dx")])


def best_line_shift(scores: DataFrame) -> DataFrame:
    """The shift with the highest score of each movie, the first among equals."""
    return scores.groupBy("movie").agg(argmax(F.col("score"), F.col("shift")).alias("shift"))


def apply_line_shift(movie: DataFrame, shifts: DataFrame, width: int) -> DataFrame:
    """Every second line of every frame moved along itself, with wraparound, by its movie's ``shift``."""
    moved = F.when(F.col("row_") % 2 == 1, F.pmod(F.col("col_") + F.col("shift"), F.lit(width))).otherwise(F.col("col_"))
    return movie.join(shifts, "movie").withColumn("col_", moved.cast("int")).drop("shift")
