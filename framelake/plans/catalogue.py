"""The queries of the imaging operators over the driver's tables, by name, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions.compat import gaussian_weights, midpoint_percentile, tidy, to_int16
from framelake.functions.tables import register_table_functions
from framelake.operators import catalog as C
from framelake.operators import movie as M
from framelake.operators import segmentation as G
from framelake.operators import splines as L
from framelake.operators import tiles as T
from framelake.operators import traces as W
from framelake.sources import views as V

H, WIDTH, NH = V.HEIGHT, V.WIDTH, 3

# The stand-in views in SQL.
MOVIE = """movie AS (SELECT vec_id AS frame, vec_id // 50 AS movie, vec_id % 50 AS frame_in_movie, CAST(i - 1 AS INTEGER) AS px,
  CAST((i - 1) % 8 AS INTEGER) AS row_, CAST((i - 1) // 8 AS INTEGER) AS col_, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i))"""
MANIFEST = MOVIE + """, manifest AS (SELECT movie, count(DISTINCT frame) AS z, min(frame) AS frame_start, max(frame) AS frame_end FROM movie GROUP BY movie)"""
ROI = MOVIE + """, active AS (SELECT px, row_, col_, CAST((row_ // 4) * 2 + col_ // 4 AS INTEGER) AS roi_id, round(stddev_samp(v), 9) AS act FROM movie GROUP BY px, row_, col_),
roi_px AS (SELECT roi_id, CASE WHEN row_number() OVER (PARTITION BY roi_id ORDER BY act DESC, px) <= 4 THEN 'body' ELSE 'neuropil' END AS kind, px, act FROM active),
roi AS (SELECT roi_id, roi_id % 9 + 1 AS grp, round(avg(act) FILTER (kind = 'neuropil') / avg(act) FILTER (kind = 'body'), 6) AS sub_coef FROM roi_px GROUP BY roi_id),
traces AS (SELECT roi_id, frame, avg(v) FILTER (kind = 'body') AS raw, avg(v) FILTER (kind = 'neuropil') AS neuropil FROM movie JOIN roi_px USING (px) GROUP BY ALL)"""
TRACE = """trace AS (SELECT user_id AS roi_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS f, event_type FROM events)"""
BINS = MOVIE + """, bins AS (SELECT movie, frame_in_movie // 8 AS bin, px, sum(v) AS v FROM movie GROUP BY ALL HAVING count(*) = 8)"""
COV = BINS + """, offs AS (SELECT k AS dcol, o AS drow FROM range(0, 3) a(k), range(-2, 3) b(o) WHERE k > 0 OR o >= 0),
pairs AS (SELECT DISTINCT px AS px_i, CAST(px + drow + 8 * dcol AS INTEGER) AS px_j FROM (SELECT DISTINCT px FROM movie), offs
  WHERE px % 8 + drow BETWEEN 0 AND 7 AND px // 8 + dcol <= 7),
cov AS (SELECT px_i, px_j, avg(c) AS cov FROM (SELECT a.movie, px_i, px_j, covar_pop(a.v, b.v) AS c FROM pairs
  JOIN bins a ON a.px = px_i JOIN bins b ON b.px = px_j AND b.movie = a.movie AND b.bin = a.bin GROUP BY ALL) GROUP BY ALL),
cor AS (SELECT px_i, px_j, CASE WHEN px_i = px_j THEN 1.0 ELSE greatest(least(cov / sqrt(a.v * b.v), 1.0), -1.0) END AS r FROM cov
  JOIN (SELECT px_i AS p, cov AS v FROM cov WHERE px_i = px_j) a ON a.p = px_i JOIN (SELECT px_i AS p, cov AS v FROM cov WHERE px_i = px_j) b ON b.p = px_j)"""
STIM = """stim AS (SELECT e.vec_id AS key_frame, e.label AS target FROM embeddings e LEFT JOIN embeddings b ON b.vec_id = e.vec_id - 1 WHERE e.label IS DISTINCT FROM b.label)"""


def hazen(column: str, percent: float) -> str:
    """Midpoint percentile of a group in SQL."""
    values, place = f"list({column} ORDER BY {column})", f"least(greatest(count({column}) * {percent / 100.0!r} + 0.5, 1.0), CAST(count({column}) AS DOUBLE))"
    low = f"CAST(floor({place}) AS BIGINT)"
    return f"{values}[{low}] + ({place} - {low}) * ({values}[least({low} + 1, count({column}))] - {values}[{low}])"


Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query and its SQL."""

    def add(query: Query) -> Query:
        FOUND[name] = (query, sql)
        return query

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """``df`` with columns rounded for comparison."""
    return df.withColumns({c: tidy(F.col(c), digits) for c in columns})


def r6(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round({expression}, {digits}) + 0.0"


@register("mean_image", f"WITH {MOVIE} SELECT movie, px, {r6('avg(v)')} AS mean FROM movie GROUP BY movie, px")
def mean_image(spark, sf):
    return rounded(M.mean_image(V.movie(spark, sf)), "mean")


@register("mean_reference", f"WITH {MOVIE} SELECT px, {r6('avg(m)')} AS mean FROM (SELECT movie, px, avg(v) AS m FROM movie GROUP BY ALL) GROUP BY px")
def mean_reference(spark, sf):
    return rounded(M.mean_reference(M.mean_image(V.movie(spark, sf))), "mean")


@register("temporal_bin_sum", f"WITH {BINS} SELECT movie, bin, px, {r6('v')} AS v FROM bins")
def temporal_bin_sum(spark, sf):
    return rounded(M.bin_frames(V.movie(spark, sf), 8), "v")


@register("temporal_bin_mean", f"WITH {MOVIE} SELECT movie, frame_in_movie // 10 AS bin, px, {r6('avg(v)')} AS v FROM movie GROUP BY ALL HAVING count(*) = 10")
def temporal_bin_mean(spark, sf):
    return rounded(M.bin_frames(V.movie(spark, sf), 10, "avg"), "v")


@register("downsample_ratio", f"WITH {MANIFEST}, k AS (SELECT greatest(1, z // 10) AS n FROM manifest WHERE movie = 0) SELECT movie, frame_in_movie // n AS bin, px, {r6('avg(v)')} AS v FROM movie, k GROUP BY movie, bin, px, n HAVING count(*) = n")
def downsample_ratio(spark, sf):
    movie = V.movie(spark, sf)
    return rounded(M.downsample(movie, V.manifest(movie), 0, 10), "v")


def covariance(spark, sf) -> DataFrame:
    """Covariance band of the stand-in recording."""
    return M.pixel_covariance(M.bin_frames(V.movie(spark, sf), 8), NH, H, WIDTH)


@register("pixel_covariance", f"WITH {COV} SELECT px_i, px_j, {r6('cov', 9)} AS cov FROM cov")
def pixel_covariance(spark, sf):
    return rounded(covariance(spark, sf), "cov", digits=9)


@register("pixel_covariance_tiled", f"WITH {COV} SELECT px_i, px_j, {r6('cov')} AS cov FROM cov")
def pixel_covariance_tiled(spark, sf):
    return rounded(T.pixel_covariance(M.bin_frames(V.movie(spark, sf), 8), NH, H, WIDTH, side=4), "cov")


@register("pixel_correlation", f"WITH {COV} SELECT px_i, px_j, {r6('r')} AS r FROM cor")
def pixel_correlation(spark, sf):
    return rounded(M.pixel_correlation(covariance(spark, sf)), "r")


@register("activity_stats", f"WITH {COV}, p AS (SELECT px_i AS px, avg(abs(r)) AS m, stddev_samp(abs(r)) AS s FROM cor GROUP BY px_i), k AS (SELECT stddev_samp(m) AS sm, stddev_samp(s) AS ss FROM p) SELECT px, {r6('coalesce(m / sm, 0) + coalesce(s / ss, 0)')} AS activity FROM p, k")
def activity_stats(spark, sf):
    return rounded(M.activity(M.pixel_correlation(covariance(spark, sf))), "activity")


@register("pixel_to_row_major", f"WITH {MOVIE} SELECT DISTINCT px, CAST(px // 8 + (px % 8) * 8 AS INTEGER) AS px_bin FROM movie")
def pixel_to_row_major(spark, sf):
    return V.movie(spark, sf).select("px").distinct().select("px", M.row_major(F.col("px"), H, WIDTH).alias("px_bin"))


@register("neighbourhood", f"WITH {MOVIE}, p AS (SELECT DISTINCT px FROM movie) SELECT px, CAST(r AS INTEGER) AS dr, CAST(c AS INTEGER) AS dc, CASE WHEN px % 8 + r BETWEEN 0 AND 7 AND px // 8 + c BETWEEN 0 AND 7 THEN CAST(px + r + 8 * c AS INTEGER) END AS neighbour FROM p, range(-1, 2) a(r), range(-1, 2) b(c)")
def neighbourhood(spark, sf):
    return M.neighbourhood_pixels(V.movie(spark, sf).select("px").distinct(), 1, H, WIDTH)


@register("deinterleave", "SELECT vec_id AS frame, vec_id % 2 AS channel, (vec_id // 2) % 4 AS slice, vec_id // 8 AS t FROM embeddings WHERE (vec_id // 2) % 4 < 3")
def deinterleave(spark, sf):
    return M.deinterleave(V.frames(spark, sf).select("frame"), 3, 2, 1)


@register("frame_to_file", f"WITH {MANIFEST} SELECT e.vec_id AS frame, movie AS file, e.vec_id - frame_start AS frame_in_file FROM embeddings e JOIN manifest ON e.vec_id BETWEEN frame_start AND frame_end")
def frame_to_file(spark, sf):
    rows = V.frames(spark, sf)
    return M.frame_to_file(rows.select("frame"), V.manifest(rows))


@register("roi_trace", f"WITH {ROI} SELECT roi_id, frame, {r6('raw')} AS raw, {r6('neuropil')} AS neuropil FROM traces")
def roi_trace(spark, sf):
    return rounded(M.region_traces(V.movie(spark, sf), V.roi_pixels(spark, sf)), "raw", "neuropil")


@register("neuropil_subtracted", f"WITH {ROI} SELECT roi_id, frame, {r6('raw - sub_coef * neuropil')} AS f FROM traces JOIN roi USING (roi_id)")
def neuropil_subtracted(spark, sf):
    found = M.subtract_background(M.region_traces(V.movie(spark, sf), V.roi_pixels(spark, sf)), V.rois(spark, sf))
    return rounded(found.select("roi_id", "frame", "f"), "f")


@register("roi_group_filter", f"WITH {ROI} SELECT roi_id, grp, px FROM roi JOIN roi_px USING (roi_id) WHERE grp IN (1, 3)")
def roi_group_filter(spark, sf):
    return V.rois(spark, sf).where(F.col("grp").isin(1, 3)).join(V.roi_pixels(spark, sf), "roi_id").select("roi_id", "grp", "px")


EDGE = ROI + """, prof AS (SELECT col_, avg(v) AS m FROM movie GROUP BY col_), gaps AS (SELECT col_, row_number() OVER (ORDER BY m, col_) AS k, m - lag(m) OVER (ORDER BY m, col_) AS gap FROM prof),
cols AS (SELECT col_ FROM gaps WHERE k < (SELECT k FROM gaps ORDER BY coalesce(gap, -1) DESC, k LIMIT 1)), edge AS (SELECT row_, frame, avg(v) AS edge FROM movie JOIN cols USING (col_) GROUP BY ALL)"""


@register("edge_signal", f"WITH {EDGE} SELECT row_, frame, {r6('edge')} AS edge FROM edge")
def edge_signal(spark, sf):
    movie = V.movie(spark, sf)
    return rounded(M.edge_signal(movie, M.edge_columns(movie)), "edge")


@register("edge_subtracted", f"WITH {EDGE} SELECT roi_id, frame, {r6('avg(v - edge)')} AS f FROM movie JOIN roi_px USING (px) JOIN edge USING (row_, frame) WHERE kind = 'body' GROUP BY roi_id, frame")
def edge_subtracted(spark, sf):
    movie = V.movie(spark, sf)
    return rounded(M.edge_subtracted(movie, V.roi_pixels(spark, sf), M.edge_signal(movie, M.edge_columns(movie))), "f")


@register("edge_neuropil_subtracted", f"""WITH {EDGE}, sides AS (SELECT roi_id, frame, avg(v - edge) FILTER (kind = 'body') AS raw, avg(v - edge) FILTER (kind = 'neuropil') AS neuropil
FROM movie JOIN roi_px USING (px) JOIN edge USING (row_, frame) GROUP BY ALL)
SELECT roi_id, frame, {r6('raw')} AS raw, {r6('neuropil')} AS neuropil, {r6('raw - coalesce(neuropil * sub_coef, 0)')} AS f FROM sides JOIN roi USING (roi_id)""")
def edge_neuropil_subtracted(spark, sf):
    movie = V.movie(spark, sf)
    return rounded(M.edge_neuropil_subtracted(movie, V.roi_pixels(spark, sf), M.edge_signal(movie, M.edge_columns(movie)), V.rois(spark, sf)), "raw", "neuropil", "f")


@register("line_shift_score", f"""WITH {MOVIE}, img AS (SELECT px, row_, col_ - 2 AS c, avg(v) AS m FROM movie WHERE row_ BETWEEN 2 AND 5 AND col_ BETWEEN 2 AND 5 GROUP BY ALL)
SELECT CAST(s AS INTEGER) AS shift, {r6('corr(a.m, b.m)')} AS score FROM range(-3, 4) t(s), img a JOIN img b ON b.row_ = a.row_ + 1 AND a.row_ % 2 = 0 WHERE ((b.c + s) % 4 + 4) % 4 = a.c GROUP BY s""")
def line_shift_score(spark, sf):
    image = V.movie(spark, sf).groupBy("px", "row_", "col_").agg(F.avg("v").alias("mean"))
    return rounded(M.line_shift_scores(image, H, WIDTH), "score")


@register("event_triggered_avg", f"WITH {MOVIE}, {STIM} SELECT CAST(o AS INTEGER) AS offset, px, {r6('avg(v)')} AS mean, count(*) AS n FROM stim, range(-3, 7) t(o) JOIN movie ON frame = key_frame + o GROUP BY o, px")
def event_triggered_avg(spark, sf):
    return rounded(M.event_triggered_mean(V.movie(spark, sf), V.stimuli(spark, sf), -3, 6), "mean")


@register("set_bin_avg", f"WITH {MOVIE}, b AS (SELECT label AS bin, vec_id AS frame FROM embeddings UNION SELECT (label + 1) % 10, vec_id FROM embeddings), ref AS (SELECT px, avg(m) AS mean FROM (SELECT movie, px, avg(v) AS m FROM movie GROUP BY ALL) GROUP BY px) SELECT bin, px, {r6('avg(v) / any_value(mean)', 4)} AS ratio FROM movie JOIN b USING (frame) JOIN ref USING (px) GROUP BY bin, px")
def set_bin_avg(spark, sf):
    movie, rows = V.movie(spark, sf), V.table(spark, sf, "embeddings")
    own = rows.select(F.col("label").alias("bin"), F.col("vec_id").alias("frame"))
    both = own.unionByName(rows.select(((F.col("label") + 1) % 10).alias("bin"), F.col("vec_id").alias("frame")))
    return rounded(M.set_bin_mean(movie, both, M.mean_reference(M.mean_image(movie))), "ratio", digits=4)


@register("response_matrix", f"WITH {ROI}, {STIM} SELECT target, roi_id, {r6('greatest(avg(raw) FILTER (o > 0) - avg(raw) FILTER (o < 0), 0)')} AS response FROM stim, range(-5, 6) t(o) JOIN traces ON frame = key_frame + o GROUP BY target, roi_id")
def response_matrix(spark, sf):
    traces = M.region_traces(V.movie(spark, sf), V.roi_pixels(spark, sf)).select("roi_id", "frame", F.col("raw").alias("f"))
    return rounded(M.response_matrix(traces, V.stimuli(spark, sf), 5, 5), "response")


@register("circular_shift", f"WITH {MOVIE} SELECT frame, CAST((row_ + 3) % 8 + 8 * ((col_ + 6) % 8) AS INTEGER) AS px, {r6('v')} AS v FROM movie")
def circular_shift(spark, sf):
    return rounded(M.circular_shift(V.movie(spark, sf), 3, -2, H, WIDTH), "v")


@register("frame_mean_trace", f"WITH {MOVIE} SELECT frame, {r6('avg(v)')} AS mean FROM movie GROUP BY frame")
def frame_mean_trace(spark, sf):
    return rounded(V.movie(spark, sf).groupBy("frame").agg(F.avg("v").alias("mean")), "mean")


@register("label_image", f"WITH {ROI}, o AS (SELECT roi_id, px FROM roi_px UNION SELECT roi_id + 1, px FROM roi_px WHERE px % 3 = 0) SELECT px, CAST(max(roi_id) AS INTEGER) AS label FROM o GROUP BY px")
def label_image(spark, sf):
    own = V.roi_pixels(spark, sf).select("roi_id", "px")
    return M.latest_label(own.unionByName(own.where("px % 3 = 0").withColumn("roi_id", F.col("roi_id") + 1)))


@register("roi_centroid", f"WITH {ROI} SELECT roi_id, CAST(round(avg(px % 8)) AS INTEGER) AS row_, CAST(round(avg(px // 8)) AS INTEGER) AS col_ FROM roi_px WHERE kind = 'body' GROUP BY roi_id")
def roi_centroid(spark, sf):
    return M.centroids(V.roi_pixels(spark, sf), H)


@register("roi_boundary", f"WITH {ROI}, n AS (SELECT roi_id, px, unnest([CASE WHEN px % 8 > 0 THEN px - 1 ELSE -1 END, CASE WHEN px % 8 < 7 THEN px + 1 ELSE -1 END, CASE WHEN px >= 8 THEN px - 8 ELSE -1 END, CASE WHEN px < 56 THEN px + 8 ELSE -1 END]) AS q FROM roi_px) SELECT DISTINCT n.roi_id, n.px FROM n LEFT JOIN roi_px r ON r.roi_id = n.roi_id AND r.px = q WHERE r.px IS NULL")
def roi_boundary(spark, sf):
    return M.boundary(V.roi_pixels(spark, sf), H, WIDTH)


@register("frame_totals", f"WITH {MANIFEST} SELECT movie, z, CAST(sum(z) OVER (ORDER BY movie) AS BIGINT) AS frames_so_far FROM manifest")
def frame_totals(spark, sf):
    return M.frame_totals(V.manifest(V.frames(spark, sf)))


@register("sync_info", "WITH s AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS block, event_type AS slice, count(*) AS n FROM events GROUP BY ALL) SELECT strftime(block, '%Y-%m-%d') AS block, CAST(min(n) * CASE WHEN count(*) > 1 THEN count(*) + 1 ELSE 1 END AS BIGINT) AS valid_frames FROM s GROUP BY block")
def sync_info(spark, sf):
    rows = V.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("block"), F.col("event_type").alias("slice")).agg(F.count("*").alias("n_frames"))
    return M.sync_info(rows)


SLICES = MOVIE + """, files AS (SELECT movie, movie // 3 % 4 AS block, slice, n - CASE WHEN movie % 5 = slice THEN 2 ELSE 0 END AS z FROM (SELECT movie, frame_in_movie % 3 AS slice, count(DISTINCT frame) AS n FROM movie GROUP BY ALL)),
cum AS (SELECT *, sum(z) OVER (PARTITION BY slice ORDER BY movie) AS so_far FROM files), ends AS (SELECT block, slice, arg_max(so_far, movie) AS slice_frames FROM cum GROUP BY ALL),
steps AS (SELECT *, slice_frames - coalesce(lag(slice_frames) OVER (PARTITION BY slice ORDER BY block), 0) AS step FROM ends),
totals AS (SELECT block, slice, slice_frames, min(step) OVER (PARTITION BY block) * 4 AS valid_frames FROM steps)"""


def slice_files(spark, sf):
    """Files of three interleaved slices in blocks that come back, some with frames missing at the end."""
    rows = V.frames(spark, sf).select("movie", "frame", (F.col("frame_in_movie") % 3).alias("slice")).withColumn("block", F.expr("movie div 3 % 4"))
    counted = rows.groupBy("block", "movie", "slice").agg(F.count("*").alias("n"))
    return counted.select("block", "movie", "slice", (F.col("n") - F.when(F.col("movie") % 5 == F.col("slice"), 2).otherwise(0)).alias("z"))


@register("sync_totals", f"WITH {SLICES} SELECT block, slice, CAST(slice_frames AS BIGINT) AS slice_frames, CAST(valid_frames AS BIGINT) AS valid_frames FROM totals")
def sync_totals(spark, sf):
    """Frames of each slice up to the end of each block, and the frames that all slices of a block have."""
    return M.sync_totals(slice_files(spark, sf))


@register("synchronised_frames", f"""WITH {SLICES}, spans AS (SELECT block, slice, coalesce(lag(slice_frames) OVER (PARTITION BY slice ORDER BY block), 0) AS low, slice_frames, valid_frames // 4 AS n FROM totals),
f AS (SELECT slice, row_number() OVER (PARTITION BY slice ORDER BY frame) - 1 AS frame FROM (SELECT DISTINCT frame, frame_in_movie % 3 AS slice FROM movie))
SELECT block, slice, count(*) AS n, CAST(min(frame) AS BIGINT) AS first, CAST(max(frame) AS BIGINT) AS last FROM f JOIN spans USING (slice) WHERE frame >= low AND frame < least(slice_frames, low + n) GROUP BY block, slice""")
def synchronised_frames(spark, sf):
    """Of each slice's frames those that all slices of the block have."""
    order = Window.partitionBy("slice").orderBy("frame")
    rows = V.frames(spark, sf).select("frame", (F.col("frame_in_movie") % 3).alias("slice"))
    own = rows.select("slice", (F.row_number().over(order) - 1).cast("long").alias("frame"))
    found = M.synchronised_frames(own, M.sync_totals(slice_files(spark, sf)))
    return found.groupBy("block", "slice").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))


@register("spline_products", f"WITH {TRACE}, p AS (SELECT roi_id, f, frame // 10 AS i, (frame % 10) / 10.0 AS u FROM trace WHERE frame < 200), b AS (SELECT roi_id, f, CAST(i + k AS INTEGER) AS j, [(1 - u) ** 3, 3 * u ** 3 - 6 * u ** 2 + 4, -3 * u ** 3 + 3 * u ** 2 + 3 * u + 1, u ** 3][k + 1] / 6 AS b FROM p, range(4) r(k)) SELECT roi_id, j, {r6('sum(b * f)')} AS by FROM b GROUP BY roi_id, j")
def spline_products(spark, sf):
    """The transposed cubic basis with a knot each ten frames, times every trace."""
    rows = V.trace(spark, sf).where("frame < 200")
    return rounded(L.products(rows, "roi_id", "frame", "f", [10.0 * (k - 3) for k in range(27)], 3)[0], "by")


@register("difference", f"WITH {TRACE} SELECT roi_id, frame, {r6('f - lag(f) OVER (PARTITION BY roi_id ORDER BY frame)')} AS d FROM trace")
def difference(spark, sf):
    return rounded(W.difference(V.trace(spark, sf)).select("roi_id", "frame", "d"), "d")


GAUSS = " + ".join(f"{w!r} * coalesce({'lag' if k < 2 else 'lead'}(f, {abs(k - 2)}) OVER w, 0)" for k, w in enumerate(gaussian_weights(5)))


@register("gaussian_smooth", f"WITH {TRACE} SELECT roi_id, frame, {r6(GAUSS)} AS smooth FROM trace WINDOW w AS (PARTITION BY roi_id ORDER BY frame)")
def gaussian_smooth(spark, sf):
    return rounded(W.gaussian_smooth(V.trace(spark, sf), 5).select("roi_id", "frame", "smooth"), "smooth")


@register("running_percentile", f"""WITH {TRACE}, r AS (SELECT roi_id, frame, count(*) OVER (PARTITION BY roi_id) AS n, list_sort(list(f) OVER (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))[3] AS x FROM trace)
SELECT roi_id, frame, {r6('CASE WHEN frame < 7 THEN max(CASE WHEN frame = 7 THEN x END) OVER p WHEN frame >= n - 7 THEN max(CASE WHEN frame = n - 8 THEN x END) OVER p ELSE x END')} AS running FROM r WHERE n > 14 WINDOW p AS (PARTITION BY roi_id)""")
def running_percentile(spark, sf):
    return rounded(W.running_percentile(V.trace(spark, sf), 7, 20), "running")


@register("running_max", f"WITH {TRACE} SELECT roi_id, frame, {r6('max(f) OVER (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)')} AS running FROM trace")
def running_max(spark, sf):
    return rounded(W.running_max(V.trace(spark, sf), 6).select("roi_id", "frame", "running"), "running")


@register("padded_block_percentile", f"WITH {TRACE}, n AS (SELECT roi_id, max(frame) + 1 AS n FROM trace GROUP BY roi_id), p AS (SELECT roi_id, frame, f FROM trace UNION ALL SELECT roi_id, unnest(range(n, (n // 16 + 1) * 16)), 0.0 FROM n WHERE n % 16 > 0) SELECT roi_id, frame // 16 AS block, {r6(hazen('f', 10))} AS threshold FROM p GROUP BY roi_id, frame // 16")
def padded_block_percentile(spark, sf):
    """Block percentiles with the last block of a trace filled up with zeros."""
    return rounded(W.block_percentile(V.trace(spark, sf), 16, 10, padded=True), "threshold")


@register("central_region", f"WITH {MOVIE} SELECT frame, {r6('avg(v) FILTER (row_ BETWEEN 2 AND 5 AND col_ BETWEEN 2 AND 5)')} AS centre, {r6('avg(v) FILTER (col_ + 1 >= 0.8 AND col_ + 1 <= 7.2)')} AS trimmed, {r6('avg(v) FILTER (col_ + 1 BETWEEN 1 AND 7)')} AS clipped FROM movie GROUP BY frame")
def central_region(spark, sf):
    """Frame means over the central part, without the sides, and between the blank edges."""
    movie = V.movie(spark, sf)
    parts = {"centre": M.central_crop(movie, H, WIDTH), "trimmed": M.side_trim(movie, WIDTH), "clipped": M.clip_blank(movie, WIDTH)}
    means = [rows.groupBy("frame").agg(F.avg("v").alias(name)) for name, rows in parts.items()]
    return rounded(means[0].join(means[1], "frame").join(means[2], "frame"), *parts)


@register("clamped_seeds", f"WITH {MOVIE}, top AS (SELECT movie, arg_max(px, abs(v)) AS px FROM movie GROUP BY movie) SELECT movie, least(greatest(px % 8 - 1, 1), 6) AS row_, least(greatest(px // 8 - 1, 1), 6) AS col_ FROM top WHERE px % 8 >= 1 AND px // 8 >= 1")
def clamped_seeds(spark, sf):
    """Seeds one up and left of each movie's strongest pixel, moved in for a neighbourhood of three; those outside are no seeds."""
    top = V.movie(spark, sf).groupBy("movie").agg(F.max_by("px", F.abs("v")).alias("px"))
    seeds = top.select("movie", (F.col("px") % H - 1).alias("row_"), (F.expr(f"px div {H}") - 1).cast("int").alias("col_"))
    return G.clamped_seeds(seeds, 3, H, WIDTH)


@register("block_percentile", f"WITH {TRACE} SELECT roi_id, frame // 16 AS block, {r6(hazen('f', 10))} AS threshold FROM trace GROUP BY roi_id, frame // 16")
def block_percentile(spark, sf):
    return rounded(W.block_percentile(V.trace(spark, sf), 16, 10), "threshold")


@register("stable_frames", f"""WITH {TRACE}, d AS (SELECT roi_id, frame, abs(f - lag(f) OVER (PARTITION BY roi_id ORDER BY frame)) AS d FROM trace),
s AS (SELECT roi_id, frame, avg(d) OVER (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS d FROM d),
c AS (SELECT roi_id, CAST(round(d * 100) AS BIGINT) AS k, count(*) AS n FROM s WHERE d IS NOT NULL GROUP BY ALL), m AS (SELECT roi_id, k FROM c QUALIFY row_number() OVER (PARTITION BY roi_id ORDER BY n DESC, k) = 1)
SELECT s.roi_id, frame FROM s JOIN m USING (roi_id) WHERE d <= k / 100.0""")
def stable_frames(spark, sf):
    return W.stable_frames(V.trace(spark, sf), 5)


@register("mode_mad_filter", f"WITH {TRACE}, c AS (SELECT roi_id, avg(f) AS m, median(f) AS mid FROM trace GROUP BY roi_id), s AS (SELECT roi_id, any_value(mid) AS mid, avg(abs(f - m)) AS mad FROM trace JOIN c USING (roi_id) GROUP BY roi_id) SELECT roi_id, frame, {r6('f')} AS f FROM trace JOIN s USING (roi_id) WHERE f < mid + 2 * mad")
def mode_mad_filter(spark, sf):
    return rounded(W.inliers(V.trace(spark, sf)), "f")


@register("exclude_and_reinsert", f"WITH {TRACE}, k AS (SELECT roi_id, frame, row_number() OVER (PARTITION BY roi_id ORDER BY frame) - 1 AS kept_frame, f FROM trace WHERE f <= 80) SELECT roi_id, frame, kept_frame, {r6('k.f')} AS f FROM trace LEFT JOIN k USING (roi_id, frame)")
def exclude_and_reinsert(spark, sf):
    trace = V.trace(spark, sf)
    kept = W.exclude_frames(trace, trace.where("f > 80").select("roi_id", "frame")).select("roi_id", "frame", F.col("kept_frame").cast("long").alias("kept_frame"), "f")
    return rounded(W.reinsert_frames(kept, trace), "f")


@register("delta_f", f"WITH {TRACE}, b AS (SELECT roi_id, {hazen('f', 10)} AS f0 FROM trace GROUP BY roi_id) SELECT roi_id, frame, {r6('(f - f0) / nullif(f0, 0)', 4)} AS df FROM trace JOIN b USING (roi_id)")
def delta_f(spark, sf):
    return rounded(W.delta_f(V.trace(spark, sf)).select("roi_id", "frame", "df"), "df", digits=4)


@register("fill_gaps", f"""WITH {TRACE}, g AS (SELECT roi_id, frame, CASE WHEN frame % 5 IN (0, 3) THEN NULL ELSE f END AS f FROM trace),
e AS (SELECT *, last_value(CASE WHEN f IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS x0, last_value(f IGNORE NULLS) OVER a AS y0, first_value(CASE WHEN f IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS x1, first_value(f IGNORE NULLS) OVER b AS y1 FROM g
 WINDOW a AS (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY roi_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT roi_id, frame, {r6('CASE WHEN x0 IS NULL THEN y1 - 1 WHEN x1 IS NULL THEN y0 + 1 WHEN x1 = x0 THEN y0 ELSE y0 + (frame - x0) / CAST(x1 - x0 AS DOUBLE) * (y1 - y0) END')} AS filled FROM e""")
def fill_gaps(spark, sf):
    holes = V.trace(spark, sf).withColumn("f", F.when(~(F.col("frame") % 5).isin(0, 3), F.col("f")))
    return rounded(W.fill_gaps(holes).select("roi_id", "frame", "filled"), "filled")


@register("saturating_cast", f"WITH {TRACE} SELECT roi_id, frame, CAST(least(greatest(round(f * 1000), -32768), 32767) AS SMALLINT) AS v FROM trace")
def saturating_cast(spark, sf):
    return V.trace(spark, sf).select("roi_id", "frame", to_int16(F.col("f") * 1000).alias("v"))


@register("normalised_image", f"""WITH {MOVIE}, i AS (SELECT movie, px, avg(v) AS m FROM movie GROUP BY ALL), k AS (SELECT movie, {hazen('m', 0.5)} AS lo, {hazen('m', 99.5)} AS hi FROM i GROUP BY movie)
SELECT movie, px, {r6('least(greatest((m - lo) / (hi - lo), 0), 1)', 5)} AS v FROM i JOIN k USING (movie)""")
def normalised_image(spark, sf):
    image = M.mean_image(V.movie(spark, sf))
    every = F.collect_list("mean")
    limits = image.groupBy("movie").agg(midpoint_percentile(every, 0.5).alias("lo"), midpoint_percentile(every, 99.5).alias("hi"))
    scaled = F.try_divide(F.col("mean") - F.col("lo"), F.col("hi") - F.col("lo"))
    return rounded(image.join(limits, "movie").select("movie", "px", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)).alias("v")), "v", digits=5)


@register("path_rewrite", "SELECT page_id, '/data/local/' || regexp_extract(url, '([^/]*)$', 1) AS path FROM pages")
def path_rewrite(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", C.move_to(F.col("url"), "/data/local").alias("path"))


@register("name_prefix", "SELECT p_partkey, split_part(p_name, ' ', 1) AS first_part, CASE WHEN contains(p_name, ' ') THEN regexp_replace(p_name, ' [^ ]*$', '') ELSE p_name END AS before_last FROM part")
def name_prefix(spark, sf):
    name = F.col("p_name")
    return V.table(spark, sf, "part").select("p_partkey", C.prefix(name, " ").alias("first_part"), C.prefix(name, " ", last=True).alias("before_last"))


@register("counter_parse", "SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS number FROM pages")
def counter_parse(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", C.counter(F.col("url")).alias("number"))


@register("whole_tens", "WITH k AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey FROM k WHERE k <= n // 10 * 10")
def whole_tens(spark, sf):
    return C.whole_tens(V.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@register("same_size_runs", "SELECT l_orderkey, l_linenumber, coalesce(lag(l_quantity) OVER w <> l_quantity, true) AS measure FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)")
def same_size_runs(spark, sf):
    rows = V.table(spark, sf, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return C.same_size_runs(rows, "l_suppkey", "k", "l_quantity").select("l_orderkey", "l_linenumber", "measure")


@register("before_gap", "WITH g AS (SELECT o_custkey, o_orderkey, coalesce(CAST(o_orderkey - lag(o_orderkey) OVER w > 1 AS INTEGER), 0) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), s AS (SELECT *, sum(gap) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gaps FROM g) SELECT o_custkey, o_orderkey FROM s WHERE gaps = 0")
def before_gap(spark, sf):
    return C.before_gap(V.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@register("session_batch", "WITH g AS (SELECT o_custkey, o_orderkey, coalesce(CAST(o_orderkey - lag(o_orderkey) OVER w > 2000 AS INTEGER), 0) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), s AS (SELECT *, sum(gap) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gaps FROM g), k AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM s WHERE gaps = 0) SELECT o_custkey, o_orderkey FROM k WHERE k <= n // 2 * 2")
def session_batch(spark, sf):
    """Sessions are customers; counters are orders, a gap is more than 2000 apart."""
    return C.session_batch(V.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 2, 2000)


@register("initialised_sessions", """WITH f AS (SELECT p_brand AS session, p_type || '_' || CAST(p_partkey AS VARCHAR) AS path, p_type AS acquisition, p_partkey FROM part),
m AS (SELECT *, row_number() OVER (PARTITION BY session, acquisition ORDER BY p_partkey, path) - 1 AS movie FROM f)
SELECT session, path, acquisition, movie, CAST(c AS INTEGER) AS channel, printf('%s_Slice01_Channel%02d_File%03d.tif', acquisition, CAST(c AS INTEGER), CAST(movie + 1 AS INTEGER)) AS output FROM m, range(1, 3) r(c)""")
def initialised_sessions(spark, sf):
    files = V.table(spark, sf, "part").select(F.col("p_brand").alias("session"), F.concat_ws("_", "p_type", F.col("p_partkey").cast("string")).alias("path"))
    return C.initialise_sessions(files, channels=2).drop("slice")


@register("output_names", "SELECT p_partkey, printf('%s_Slice%02d_Channel%02d_File%03d.tif', p_brand, CAST(p_size % 4 + 1 AS INTEGER), CAST(p_size % 2 + 1 AS INTEGER), CAST(p_size AS INTEGER)) AS name FROM part")
def output_names(spark, sf):
    size = F.col("p_size")
    return V.table(spark, sf, "part").select("p_partkey", C.output_name(F.col("p_brand"), size % 4 + 1, size % 2 + 1, size).alias("name"))


JOBS = "jobs AS (SELECT o_orderkey AS job_id, o_orderdate AS created, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'inProgress' ELSE 'jobs' END AS state FROM orders)"


def jobs(spark, sf) -> DataFrame:
    """Orders as jobs."""
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "inProgress").otherwise("jobs")
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created"), state.alias("state"))


@register("job_queue", f"WITH {JOBS}, n AS (SELECT min(job_id) AS next_job FROM jobs WHERE state = 'jobs') SELECT state, count(*) AS n, CASE WHEN state = 'jobs' THEN any_value(next_job) END AS next_job FROM jobs, n GROUP BY state")
def job_queue(spark, sf):
    rows = jobs(spark, sf)
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.min(F.when(F.col("state") == "jobs", F.col("job_id"))).alias("next_job"))


@register("job_log", f"WITH {JOBS} SELECT job_id, state || chr(9) || strftime(created, '%Y-%m-%d') AS line FROM jobs")
def job_log(spark, sf):
    return jobs(spark, sf).select("job_id", F.concat_ws("\t", "state", F.date_format("created", "yyyy-MM-dd")).alias("line"))


@register("pending_jobs", f"WITH {JOBS} SELECT job_id FROM jobs WHERE job_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_jobs(spark, sf):
    done = V.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"), F.lit("motion").alias("stage"))
    return C.pending(jobs(spark, sf), done, "motion").select("job_id")


@register("pixel_histogram", f"WITH {MOVIE} SELECT movie, CAST(floor(v * 20) AS BIGINT) AS bucket, count(*) AS n FROM movie GROUP BY ALL")
def pixel_histogram(spark, sf):
    return V.movie(spark, sf).groupBy("movie", F.floor(F.col("v") * 20).alias("bucket")).agg(F.count("*").alias("n"))


@register("set_operations", f"WITH {ROI} SELECT 'union' AS op, count(*) AS n FROM (SELECT px FROM roi_px WHERE roi_id < 2 UNION SELECT px FROM roi_px WHERE px % 2 = 0) UNION ALL SELECT 'intersect', count(*) FROM (SELECT px FROM roi_px WHERE roi_id < 2 INTERSECT SELECT px FROM roi_px WHERE px % 2 = 0) UNION ALL SELECT 'except', count(*) FROM (SELECT px FROM roi_px WHERE roi_id < 2 EXCEPT SELECT px FROM roi_px WHERE px % 2 = 0)")
def set_operations(spark, sf):
    a, b = (V.roi_pixels(spark, sf).where(c).select("px") for c in ("roi_id < 2", "px % 2 = 0"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b).distinct()}
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, d in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("band_offsets", f"WITH {COV} SELECT CAST(dcol AS INTEGER) AS dcol, CAST(drow AS INTEGER) AS drow, count(*) AS n, {r6('avg(cov)', 9)} AS cov FROM cov JOIN offs ON px_j // 8 - px_i // 8 = dcol AND px_j % 8 - px_i % 8 = drow GROUP BY dcol, drow")
def band_offsets(spark, sf):
    """Mean covariance over the image for each offset of the stored band."""
    band = covariance(spark, sf).select("*", (F.expr(f"px_j div {H}") - F.expr(f"px_i div {H}")).cast("int").alias("dcol"), (F.col("px_j") % H - F.col("px_i") % H).alias("drow"))
    found = band.join(M.band_offsets(spark, NH), ["dcol", "drow"]).groupBy("dcol", "drow").agg(F.count("*").alias("n"), F.avg("cov").alias("cov"))
    return rounded(found.select(F.col("dcol").cast("int"), F.col("drow").cast("int"), "n", "cov"), "cov", digits=9)


@register("band_offsets_sql", f"WITH {COV} SELECT CAST(dcol AS INTEGER) AS dcol, CAST(drow AS INTEGER) AS drow, count(*) AS n FROM (SELECT DISTINCT row_, col_ FROM movie), offs WHERE row_ + drow BETWEEN 0 AND 7 AND col_ + dcol BETWEEN 0 AND 7 GROUP BY dcol, drow")
def band_offsets_sql(spark, sf):
    """How many of the recording's pixels have a partner at each offset of the band, by the SQL table function."""
    register_table_functions(spark)
    V.movie(spark, sf).select("row_", "col_").distinct().createOrReplaceTempView("framelake_pixels")
    return spark.sql(f"SELECT dcol, drow, count(*) AS n FROM framelake_pixels, LATERAL band_offsets({NH}) WHERE row_ + drow BETWEEN 0 AND {H - 1} AND col_ + dcol BETWEEN 0 AND {WIDTH - 1} GROUP BY dcol, drow")


@register("neighbour_pixels_sql", f"WITH {MOVIE}, p AS (SELECT DISTINCT px FROM movie) SELECT px, CAST(px + r + 8 * c AS INTEGER) AS neighbour FROM p, range(-1, 2) a(r), range(-1, 2) b(c) WHERE px % 8 + r BETWEEN 0 AND 7 AND px // 8 + c BETWEEN 0 AND 7")
def neighbour_pixels_sql(spark, sf):
    """Square neighbourhoods by the SQL table function."""
    register_table_functions(spark)
    V.movie(spark, sf).select("px").distinct().createOrReplaceTempView("framelake_pixels")
    return spark.sql(f"SELECT px, neighbour FROM framelake_pixels, LATERAL neighbour_pixels(px, 1, {H}, {WIDTH})")


@register("event_window_sql", f"WITH {MOVIE}, {STIM} SELECT key_frame, CAST(o AS INTEGER) AS lag, key_frame + o AS frame FROM stim, range(-3, 7) t(o)")
def event_window_sql(spark, sf):
    """Frames around events by the SQL table function."""
    register_table_functions(spark)
    V.stimuli(spark, sf).createOrReplaceTempView("framelake_stimuli")
    return spark.sql("SELECT key_frame, lag, frame FROM framelake_stimuli, LATERAL event_window(key_frame, -3, 6)")


SEEDS = """seeds AS (SELECT CAST(i AS INTEGER) AS seed, (i % 4) * 2 + 0.5 AS sr, (i // 4) * 2 + 0.5 AS sc FROM range(16) r(i)),
discs AS (SELECT seed, CAST(i AS INTEGER) AS px FROM seeds, range(64) p(i) WHERE (i % 8 - sr) ** 2 + (i // 8 - sc) ** 2 < 4)"""


@register("seed_discs", f"WITH {SEEDS}, {MOVIE} SELECT seed, px, {r6('avg(v)')} AS mean FROM discs JOIN movie USING (px) GROUP BY seed, px")
def seed_discs(spark, sf):
    """Mean image around every seed of a grid."""
    discs = G.seed_discs(spark, 2, 2.0, H, WIDTH)
    return rounded(V.movie(spark, sf).join(discs, "px").groupBy("seed", "px").agg(F.avg("v").alias("mean")), "mean")


@register("seed_covariance", f"WITH {BINS}, {SEEDS}, pairs AS (SELECT a.seed, a.px AS px_i, b.px AS px_j FROM discs a JOIN discs b ON a.seed = b.seed AND a.px <= b.px), c AS (SELECT a.movie, a.px AS px_i, b.px AS px_j, covar_pop(a.v, b.v) AS c FROM (SELECT DISTINCT px_i, px_j FROM pairs) JOIN bins a ON a.px = px_i JOIN bins b ON b.px = px_j AND b.movie = a.movie AND b.bin = a.bin GROUP BY ALL) SELECT seed, px_i, px_j, {r6('avg(c)')} AS cov FROM pairs JOIN c USING (px_i, px_j) GROUP BY seed, px_i, px_j")
def seed_covariance(spark, sf):
    return rounded(G.seed_covariance(M.bin_frames(V.movie(spark, sf), 8), G.seed_discs(spark, 2, 2.0, H, WIDTH)), "cov")


@register("nearest_seed", f"WITH {MOVIE}, own AS (SELECT frame, v, CAST(least(row_ // 3, 2) + 3 * least(col_ // 3, 2) AS INTEGER) AS seed FROM movie) SELECT seed, frame, count(*) AS n, {r6('avg(v)')} AS mean FROM own GROUP BY seed, frame")
def nearest_seed(spark, sf):
    """Mean of the pixels nearest to each grid seed, in every frame."""
    rows = V.movie(spark, sf).withColumn("seed", G.nearest_seed(F.col("row_"), F.col("col_"), 3, H, WIDTH))
    return rounded(rows.groupBy("seed", "frame").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), "mean")


@register("movie_correlations", f"WITH {MOVIE}, {SEEDS}, pairs AS (SELECT a.seed, a.px AS px_i, b.px AS px_j FROM discs a JOIN discs b ON a.seed = b.seed AND a.px <= b.px) SELECT seed, px_i, px_j, round(corr(a.v, b.v), 6) + 0.0 AS r FROM pairs JOIN movie a ON a.px = px_i JOIN movie b ON b.px = px_j AND b.frame = a.frame GROUP BY seed, px_i, px_j")
def movie_correlations(spark, sf):
    return rounded(G.movie_correlations(V.movie(spark, sf), G.seed_discs(spark, 2, 2.0, H, WIDTH)), "r")


@register("polygon_region", f"WITH {MOVIE} SELECT frame, count(*) AS n, {r6('avg(v)')} AS mean FROM movie WHERE row_ + col_ > 4.5 AND row_ < 6.5 AND col_ < 5.5 GROUP BY frame")
def polygon_region(spark, sf):
    """Mean within a polygon in every frame."""
    inside = V.movie(spark, sf).where(G.inside_polygon(F.col("row_"), F.col("col_"), [(-1.0, 5.5), (6.5, 5.5), (6.5, -2.0)]))
    return rounded(inside.groupBy("frame").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), "mean")


@register("region_movie", f"WITH {ROI}, c AS (SELECT roi_id, CAST(round(avg(px % 8)) AS INTEGER) AS r, CAST(round(avg(px // 8)) AS INTEGER) AS c FROM roi_px WHERE kind = 'body' GROUP BY roi_id) SELECT roi_id, frame, row_, col_, v FROM movie JOIN c ON row_ BETWEEN greatest(r - 2, 0) AND least(r + 2, 7) AND col_ BETWEEN greatest(c.c - 2, 0) AND least(c.c + 2, 7)")
def region_movie(spark, sf):
    return G.region_movie(V.movie(spark, sf), G.region_window(V.roi_pixels(spark, sf), 2, H, WIDTH))


@register("display_intensity", f"WITH {MOVIE} SELECT frame, px, {r6('sqrt(greatest(v, 0))')} AS root, {r6('pow(greatest(v, 0), 0.25)')} AS gamma FROM movie")
def display_intensity(spark, sf):
    v = F.col("v")
    return rounded(V.movie(spark, sf).select("frame", "px", M.display_intensity(v).alias("root"), M.display_intensity(v, "gamma").alias("gamma")), "root", "gamma")


@register("overview_image", f"WITH {MOVIE}, m AS (SELECT px, avg(v) AS a, stddev_samp(v) AS s FROM movie GROUP BY px), n AS (SELECT px, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM m) SELECT px, {r6('0.7 * a + 0.3 * s')} AS red, {r6('a')} AS green, {r6('a')} AS blue FROM n")
def overview_image(spark, sf):
    movie = V.movie(spark, sf)
    anatomy, activity = (M.unit_scale(movie.groupBy("px").agg(how("v").alias("v")), "v") for how in (F.avg, F.stddev_samp))
    return rounded(M.overview(anatomy, activity), "red", "green", "blue")


@register("stimulus_frames", f"WITH {STIM}, s AS (SELECT key_frame // 50 AS block, key_frame % 50 AS frame, target AS label FROM stim), b AS (SELECT vec_id // 50 AS block, count(*) AS frames FROM embeddings GROUP BY ALL), o AS (SELECT block, sum(frames) OVER (ORDER BY block) - frames AS start FROM b) SELECT block, CAST(start + frame AS BIGINT) AS key_frame FROM s JOIN o USING (block) WHERE label = 3")
def stimulus_frames(spark, sf):
    rows = V.frames(spark, sf)
    stimuli = V.stimuli(spark, sf).select(F.expr(f"key_frame div {V.FILE_FRAMES}").alias("block"), (F.col("key_frame") % V.FILE_FRAMES).alias("frame"), "target")
    return M.stimulus_frames(stimuli, rows.groupBy(F.col("movie").alias("block")).agg(F.count("*").alias("frames")), 3)


@register("first_trial_frames", "SELECT label AS target, vec_id // 25 AS trial, min(vec_id) AS key_frame FROM embeddings GROUP BY ALL")
def first_trial_frames(spark, sf):
    rows = V.table(spark, sf, "embeddings")
    return M.first_trial_frames(rows.select(F.col("label").alias("target"), F.expr("vec_id div 25").alias("trial"), F.col("vec_id").alias("frame")))


@register("time_axis", f"WITH {TRACE} SELECT roi_id, frame, {r6('CAST(frame AS DOUBLE) * CAST(0.0333 AS DOUBLE)')} AS seconds FROM trace")
def time_axis(spark, sf):
    return rounded(M.time_axis(V.trace(spark, sf), 0.0333).select("roi_id", "frame", "seconds"), "seconds")


@register("session_counts", "SELECT o_custkey, count(*) AS n, count(*) % 10 <> 0 AS odd FROM orders GROUP BY o_custkey")
def session_counts(spark, sf):
    return C.session_counts(V.table(spark, sf, "orders"), "o_custkey")


@register("processing_order", f"WITH {MANIFEST} SELECT movie, CASE WHEN movie = 4 THEN 0 ELSE movie + 1 END AS turn FROM manifest")
def processing_order(spark, sf):
    return C.processing_order(V.manifest(V.frames(spark, sf)).select("movie"), 4)


@register("new_files", "SELECT DISTINCT url AS path FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def new_files(spark, sf):
    rows = V.table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return C.register_files(rows.where("page_id % 3 = 0"), rows)


@register("valid_names", "SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g'), '^([^A-Za-z]|$)', 'x\\1') AS name FROM part")
def valid_names(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", C.valid_identifier(F.col("p_name")).alias("name"))


@register("scanner_layout", "SELECT p_partkey, p_size % 2 = 1 AS stack, CAST(p_size % 4 + 1 AS INTEGER) AS channels, CAST(CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 1 THEN p_size ELSE 1 END ELSE p_size END AS INTEGER) AS slices, CAST(CASE WHEN p_size % 2 = 1 THEN 2 ELSE 0 END AS INTEGER) AS flyback, round(1.0 / (p_size + 10), 6) + 0.0 AS period FROM part")
def scanner_layout(spark, sf):
    size = F.col("p_size")
    values = {"enable": size % 2, "channels": size % 4 + 1, "flyback": F.lit(2), "period": 1.0 / (size + 10)}

    def header(k: int) -> F.Column:
        stack, slices, flyback, channels, period = C.SCANNER_FIELDS[k]
        deep = size + 2 if k in (0, 2) else size
        parts = ((stack, values["enable"]), (slices, deep), (flyback, values["flyback"]), (channels, values["channels"]), (period, values["period"]))
        return F.create_map(*[x for name, v in parts for x in (F.lit(name), v.cast("double"))])

    meta = V.table(spark, sf, "part").select("p_partkey", F.when(size % 3 == 0, header(0)).when(size % 3 == 1, header(1)).otherwise(header(3)).alias("fields"))
    return rounded(C.scanner_layout(meta), "period")


@register("migrate_regions", "SELECT l_orderkey AS acquisition, l_linenumber AS id, CAST(l_quantity AS INTEGER) % 9 + 1 AS grp FROM lineitem")
def migrate_regions(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("acquisition"), F.struct(F.col("l_linenumber").alias("i"), (F.col("l_quantity").cast("int") % 9 + 1).alias("g")).alias("one"))
    old = rows.groupBy("acquisition").agg(F.collect_list("one").alias("all")).select("acquisition", F.col("all.i").alias("ids"), F.col("all.g").alias("groups"))
    return G.migrate_regions(old)


@register("second_largest", "WITH s AS (SELECT o_custkey AS seed, CAST(o_orderkey % 4 AS INTEGER) AS cluster, count(*) AS n FROM orders GROUP BY ALL) SELECT seed, cluster, n FROM s QUALIFY row_number() OVER (PARTITION BY seed ORDER BY n DESC, cluster) = 2")
def second_largest(spark, sf):
    return G.second_largest(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("seed"), (F.col("o_orderkey") % 4).cast("int").alias("cluster")))


@register("merge_clusters", "SELECT o_orderkey AS px, CAST(CASE WHEN c = 2 THEN 0 WHEN c > 2 THEN c - 1 ELSE c END AS INTEGER) AS cluster FROM (SELECT o_orderkey, o_orderkey % 5 AS c FROM orders)")
def merge_clusters(spark, sf):
    return G.merge_clusters(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("px"), (F.col("o_orderkey") % 5).cast("int").alias("cluster")), 0, 2)


@register("swallowed_regions", f"WITH {ROI}, l AS (SELECT px, max(roi_id) AS label FROM roi_px GROUP BY px), big AS (SELECT px FROM active WHERE row_ < 5 OR act > (SELECT avg(act) FROM active)) SELECT label, count(*) AS n, count(*) FILTER (px IN (SELECT px FROM big)) AS hits FROM l GROUP BY label HAVING count(*) FILTER (px IN (SELECT px FROM big)) >= 10")
def swallowed_regions(spark, sf):
    """Regions that a mask of active pixels covers by ten pixels or more."""
    pixels = V.roi_pixels(spark, sf)
    mean = pixels.agg(F.avg("act").alias("mean"))
    mask = pixels.crossJoin(F.broadcast(mean)).where((F.col("px") % H < 5) | (F.col("act") > F.col("mean")))  # one row
    return G.covered_regions(M.latest_label(pixels), mask).where("hits >= 10")


@register("line_shift_applied", f"WITH {MOVIE} SELECT frame, row_, CAST(CASE WHEN row_ % 2 = 1 THEN (col_ + movie % 3 + 8) % 8 ELSE col_ END AS INTEGER) AS col_, v FROM movie")
def line_shift_applied(spark, sf):
    movie = V.movie(spark, sf)
    shifts = movie.select("movie").distinct().withColumn("shift", F.col("movie") % 3)
    return M.apply_line_shift(movie, shifts, WIDTH).select("frame", "row_", "col_", "v")


@register("line_shift_best", "WITH g AS (SELECT o_custkey AS movie, o_orderkey % 7 - 3 AS shift, round(avg(o_totalprice) / 100000) AS score FROM orders GROUP BY ALL) SELECT movie, shift FROM g QUALIFY row_number() OVER (PARTITION BY movie ORDER BY score DESC, shift) = 1")
def line_shift_best(spark, sf):
    keys = [F.col("o_custkey").alias("movie"), (F.col("o_orderkey") % 7 - 3).alias("shift")]
    return M.best_line_shift(V.table(spark, sf, "orders").groupBy(*keys).agg(F.round(F.avg("o_totalprice") / 100000).alias("score")))


@register("first_occurrences", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_occurrences(spark, sf):
    return G.first_occurrences(V.table(spark, sf, "events"), "event_id", "user_id", "event_type")


@register("region_edits", f"WITH {ROI} SELECT CASE WHEN roi_id > 1 THEN roi_id - 1 ELSE roi_id END AS id, CASE WHEN roi_id = 3 THEN 7 ELSE grp END AS grp, {r6('CASE WHEN roi_id = 0 THEN sub_coef + 0.05 ELSE sub_coef END')} AS sub_coef FROM roi WHERE roi_id <> 1")
def region_edits(spark, sf):
    regions = V.rois(spark, sf).withColumnRenamed("roi_id", "id")
    return rounded(G.nudge_coefficient(G.relabel_region(G.delete_region(regions, 1, renumber=True), 2, 7), 0, 0.05), "sub_coef")


@register("label_cleared", f"WITH {ROI} SELECT px, max(roi_id) AS label FROM roi_px GROUP BY px HAVING max(roi_id) <> 2")
def label_cleared(spark, sf):
    return G.clear_labels(M.latest_label(V.roi_pixels(spark, sf)), 2)


def queries() -> dict[str, Query]:
    """Query functions (spark, sf_dir) by name."""
    return {name: query for name, (query, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name."""
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
