"""Queries of the operators that run a numeric kernel in Arrow tasks, over the stand-in recording and traces.

SQL can't express them; ``tests`` holds each against synthetic truth or brute force.  Results are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.compat import tidy
from framelake.operators import baseline as B
from framelake.operators import extraction as E
from framelake.operators import images as I
from framelake.operators import movie as M
from framelake.operators import nonrigid as N
from framelake.operators import registration as R
from framelake.operators import scan as S
from framelake.operators import segmentation as G
from framelake.operators import splines as L
from framelake.sources import views as V
from framelake.sources.stages import kept

H, WIDTH = V.HEIGHT, V.WIDTH
#: Knots of the traces' splines: one each ten frames, whose domain is 0 to 200.
KNOTS = [10.0 * (k - 3) for k in range(27)]
Query = Callable[[SparkSession, str], DataFrame]


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frame rows made positive, as a camera's are."""
    rows = V.frames(spark, sf).select("movie", "frame", "values")
    return rows.withColumn("values", F.transform("values", lambda v: v + F.lit(1.0)))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of the pixels around the centres of four regions, a whole square each."""
    seeds = spark.createDataFrame([(2 + 8 * 2,), (2 + 8 * 5,), (5 + 8 * 2,), (5 + 8 * 5,)], "px int")
    around = M.neighbourhood_pixels(seeds, 2, H, WIDTH).where("neighbour IS NOT NULL")
    return G.movie_correlations(V.movie(spark, sf), around.select(F.col("px").alias("seed"), F.col("neighbour").alias("px")))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """Region traces with their background taken off."""
    return M.subtract_background(M.region_traces(V.movie(spark, sf), V.roi_pixels(spark, sf)), V.rois(spark, sf))


def with_reference(kernel: Callable[..., DataFrame], *more) -> Query:
    """A kernel over frames and the mean image of each movie."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = frames(spark, sf)
        return kernel(rows, R.reference_images(rows), *more)

    return query


def numbers_rounded(df: DataFrame) -> DataFrame:
    """``df`` with its real numbers, alone or in arrays, rounded to six digits."""
    out = {c: tidy(F.col(c)) for c, kind in df.dtypes if kind == "double"}
    out |= {c: F.transform(c, lambda v: tidy(v)) for c, kind in df.dtypes if kind == "array<double>"}
    return df.withColumns(out)


def strategy(name: str) -> Query:
    """Corrected frames by a strategy, all brought onto the first movie."""
    return lambda spark, sf: R.correct_motion(frames(spark, sf), H, WIDTH, name, reference_movie=0)


def recording(name: str) -> Query:
    """Corrected frames by a strategy that also brings movies onto the first one."""
    return lambda spark, sf: N.correct_recording(frames(spark, sf), H, WIDTH, 0, **N.RECORDING_STRATEGIES[name])


def activity_equalised(spark: SparkSession, sf: str) -> DataFrame:
    """The activity image of each movie's pixels, scaled and adaptively equalised as one image."""
    activity = V.movie(spark, sf).groupBy("movie", "px").agg(F.stddev_samp("v").alias("v"))
    pictures = activity.groupBy("movie").agg(F.transform(F.sort_array(F.collect_list(F.struct("px", "v"))), lambda s: s["v"]).alias("image"))

    def kernel(picture):
        values = R.image(picture, H)
        low, high = values.min(), values.max()
        return (R.flat(I.equalise((values - low) / ((high - low) or 1.0), 2)),)

    return R.per_frame(pictures, kernel, ["image"], "equalised array<double>", ("movie",))


def split(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster 0 of every seed in two."""
    near = kept(pairs(spark, sf))  # a row for each pair, read twice
    return G.split_cluster(G.cluster_seeds(near, H, 2), near, 0)


def background(spark: SparkSession, sf: str) -> DataFrame:
    """The cluster that stands in as background beside each seed's own, by its pixels' correlation with the seed."""
    near = kept(pairs(spark, sf))  # a row for each pair, read twice
    own = near.where("px_i = seed OR px_j = seed").select("seed", F.when(F.col("px_i") == F.col("seed"), F.col("px_j")).otherwise(F.col("px_i")).alias("px"), F.array("r").alias("vector"))
    return G.background_cluster(G.cluster_seeds(near, H, 2).join(own, ["seed", "px"]))


def source_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Activity of the patches' footprints."""
    movie = V.movie(spark, sf)
    return E.footprint_traces(movie, E.footprints(movie, 2, 4, H, WIDTH))


def scan_motion(spark: SparkSession, sf: str) -> DataFrame:
    """Knots of every frame's motion at the scan's own timing."""
    rows = frames(spark, sf)
    return S.scan_motions(rows, R.reference_images(rows), H, WIDTH, accept=0.0)


def scan_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with their pixels scattered to where they were recorded, holes filled."""
    rows = frames(spark, sf)
    return S.apply_scan_motions(rows, scan_motion(spark, sf), H, WIDTH)


def spline_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    """Every trace and its slope by a penalised cubic spline with a knot each ten frames."""
    rows = V.trace(spark, sf)
    weights = kept(L.fit(rows, "roi_id", "frame", "f", KNOTS, 3, 0.7))
    turned, inner = L.slope(weights, "roi_id", KNOTS, 3)
    values = L.evaluate(rows, weights, "roi_id", "frame", KNOTS, 3).select("roi_id", "frame", F.col("value").alias("smooth"))
    return values.join(L.evaluate(rows, turned, "roi_id", "frame", inner, 2).select("roi_id", "frame", F.col("value").alias("slope")), ["roi_id", "frame"])


KERNELS: dict[str, Query] = {
    "spline_smoothed": spline_smoothed,
    "source_models": lambda spark, sf: E.source_results(V.movie(spark, sf), 2, 4, H, WIDTH)["models"],
    "source_models_second_order": lambda spark, sf: E.source_models(M.region_traces(V.movie(spark, sf), V.roi_pixels(spark, sf)).select("roi_id", "frame", F.col("raw").alias("f")), 2).drop("frames"),
    "scan_motion": scan_motion,
    "scan_corrected": scan_corrected,
    "subpixel_shift": with_reference(R.frame_shifts, H),
    "segment_shift": with_reference(R.segment_shifts, H, WIDTH),
    "block_shift": with_reference(N.block_shifts, H, 2),
    "line_displacement": with_reference(R.line_shifts, H),
    "scan_line_displacement": with_reference(N.scan_line_shifts, H),
    "line_displacement_fine": with_reference(R.line_shifts, H, 16, 1.0, 10.0),
    "luminance_flattened": lambda spark, sf: R.flattened_frames(frames(spark, sf), H),
    "recursive_mean": lambda spark, sf: N.recursive_mean(frames(spark, sf), H),
    "affine_field": lambda spark, sf: N.movie_fields(N.mean_images(frames(spark, sf)), 0, H, WIDTH, nonrigid=False),
    "demons_field": lambda spark, sf: N.movie_fields(N.mean_images(frames(spark, sf)), 0, H, WIDTH, smooth=1.0),
    "activity_equalised": activity_equalised,
    "ncut_clusters": lambda spark, sf: G.cluster_seeds(pairs(spark, sf), H, 2),
    "ncut_clusters_counted": lambda spark, sf: G.cluster_seeds(pairs(spark, sf), H, 0),
    "ncut_regions": lambda spark, sf: G.region_of(G.cluster_seeds(pairs(spark, sf), H, 2), H, WIDTH),
    "split_cluster": split,
    "background_cluster": background,
    "neuropil_coefficient": lambda spark, sf: B.neuropil_coefficients(traces(spark, sf)),
    "paired_coefficient": lambda spark, sf: B.paired_coefficients(traces(spark, sf)),
    "source_footprints": lambda spark, sf: E.footprints(V.movie(spark, sf), 2, 4, H, WIDTH),
    "source_traces": source_traces,
    "source_results": lambda spark, sf: E.source_results(V.movie(spark, sf), 2, 4, H, WIDTH)["traces"],
    "source_background": lambda spark, sf: E.source_results(V.movie(spark, sf), 2, 4, H, WIDTH)["background"],
    "deconvolution": lambda spark, sf: E.deconvolved(V.trace(spark, sf)),
    "baseline_delta_f": lambda spark, sf: B.baseline_delta_f(traces(spark, sf)),
} | {f"motion_{name}": strategy(name) for name in R.STRATEGIES} | {f"motion_{name}": recording(name) for name in N.RECORDING_STRATEGIES}


def rounded(query: Query) -> Query:
    """A query with rounded numbers."""
    return lambda spark, sf: numbers_rounded(query(spark, sf))


def queries() -> dict[str, Query]:
    """Query functions (spark, sf_dir) by name."""
    return {name: rounded(query) for name, query in KERNELS.items()}
