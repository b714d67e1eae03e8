"""Queries that go through a store or the job stream and come back, each with the SQL of what must come back.

The stores are written to a folder that all executors share; a query makes its own and reads it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import catalog as C
from framelake.operators import movie as M
from framelake.operators import registration as R
from framelake.operators import segmentation as G
from framelake.sources import stack, tiff
from framelake.sources import views as V
from framelake.sources.stages import new_folder
from framelake.streaming import bins as B
from framelake.streaming import jobs as J

from .catalogue import BINS, COV, MANIFEST, MOVIE, NH, ROI, STIM, H, WIDTH, covariance, r6, register, rounded


@register("pixel_store_read", f"WITH {MOVIE} SELECT px, frame, v FROM movie WHERE px IN (3, 12, 40) AND frame BETWEEN 10 AND 79")
def pixel_store_read(spark, sf):
    """Three pixels and a range of frames of the pixel-major store."""
    folder = new_folder(spark, "pixels")
    tiff.write_pixel_major(V.movie(spark, sf), folder)
    return tiff.read_pixels(spark, folder, [3, 12, 40], 10, 79)


@register("corrected_store_read", f"WITH {MOVIE} SELECT frame, px, v FROM movie WHERE frame % 2 = 1 AND movie IN (2, 3)")
def corrected_store_read(spark, sf):
    """One slice of two movies of the partitioned store of corrected frames."""
    folder = new_folder(spark, "corrected")
    rows = V.frames(spark, sf).withColumns({"slice": F.col("frame") % 2, "channel": F.lit(0)})
    tiff.write_corrected(rows, folder)
    found = spark.read.parquet(folder).where("slice = 1 AND movie IN (2, 3)")
    return V.explode_pixels(found, H).select("frame", "px", "v")


@register("covariance_store_read", f"WITH {COV} SELECT px_j, {r6('cov', 9)} AS cov, 3 AS neighbourhood, 8 AS bin FROM cov WHERE px_i = 9")
def covariance_store_read(spark, sf):
    """One pixel's covariances and the settings beside the band."""
    folder = new_folder(spark, "covariance")
    tiff.write_covariance(covariance(spark, sf), folder, neighbourhood=NH, bin=8)
    settings = spark.read.parquet(f"{folder}/settings").first()
    found = spark.read.parquet(f"{folder}/band").where("px_i = 9")
    both = found.select("px_j", "cov", F.lit(settings["neighbourhood"]).cast("int").alias("neighbourhood"), F.lit(settings["bin"]).cast("int").alias("bin"))
    return rounded(both, "cov", digits=9)


@register("appended_bins", f"WITH {BINS} SELECT bin + 6 * movie AS bin, px, {r6('v')} AS v FROM bins WHERE movie < 3")
def appended_bins(spark, sf):
    """Three movies appended one after the other, the second one twice as by a retried writer."""
    folder = new_folder(spark, "bins")
    bins = M.bin_frames(V.movie(spark, sf), 8)
    for movie in (0, 1, 1, 2):
        tiff.append_bins(bins.where(F.col("movie") == movie).select("bin", "px", "v"), folder, f"movie{movie}")
    return rounded(spark.read.parquet(folder).select("bin", "px", "v"), "v")


@register("saved_catalog", f"WITH {MANIFEST} SELECT 'b' AS acquisition, movie + 100 AS movie, z, frame_start, frame_end FROM manifest")
def saved_catalog(spark, sf):
    """One of two saved acquisitions, saved twice."""
    folder = new_folder(spark, "catalog")
    files = V.manifest(V.frames(spark, sf))
    for name in ("a", "b", "b"):
        C.write_catalog(files.withColumn("movie", F.col("movie") + (100 if name == "b" else 0)), folder, name)
    return C.read_catalog(spark, folder, "b").select("acquisition", "movie", "z", "frame_start", "frame_end")


@register("region_snapshots", f"WITH {ROI} SELECT roi_id, grp, {r6('2 * sub_coef')} AS sub_coef FROM roi")
def region_snapshots(spark, sf):
    """The second version of the region table, written twice."""
    folder, rois = new_folder(spark, "regions"), V.rois(spark, sf)
    for version in (1, 2, 2):
        tiff.write_snapshot(rois.withColumn("sub_coef", version * F.col("sub_coef")), folder, version)
    return rounded(spark.read.parquet(folder).where("version = 2").select("roi_id", "grp", "sub_coef"), "sub_coef")


@register("numbered_files", f"WITH {MOVIE}, f AS (SELECT DISTINCT frame, movie, frame_in_movie FROM movie), z AS (SELECT movie, count(*) AS n FROM f GROUP BY movie) SELECT printf('m%05d.tif', 9999 - f.movie) AS path, frame_in_movie, CAST((SELECT coalesce(sum(n), 0) FROM z WHERE z.movie > f.movie) AS BIGINT) + frame_in_movie AS frame, CAST((SELECT count(*) FROM z WHERE z.movie > f.movie) AS BIGINT) AS movie FROM f")
def numbered_files(spark, sf):
    """Global frame numbers by the order of file names, which runs against the movies'."""
    rows = V.frames(spark, sf).select(F.format_string("m%05d.tif", 9999 - F.col("movie")).alias("path"), "frame_in_movie")
    return tiff.number_files(rows).select("path", "frame_in_movie", "frame", "movie")


@register("job_stream", "SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'done' END AS state FROM orders")
def job_stream(spark, sf):
    """Orders as job files, processed as a stream by two stages; the first one fails for a status."""
    folder = new_folder(spark, "jobs")
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("acquisition"))
    orders.write.json(f"{folder}/inbox")
    stages = [
        ("motion", lambda jobs: jobs.select("job_id", (F.col("acquisition") != "P").alias("ok")), True),
        ("extraction", lambda jobs: jobs.select("job_id", (F.col("acquisition") != "O").alias("ok")), False),
    ]
    J.process(J.watch(spark, f"{folder}/inbox", 1000), f"{folder}/manifest", f"{folder}/checkpoint", stages).awaitTermination()
    return J.job_states(J.manifest(spark, f"{folder}/manifest"), len(stages))


@register("realistic_shifts", f"SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity - 25) > 10 OR l_discount * 200 > 10 THEN 0.0 ELSE l_quantity - 25 END + 0.0 AS dy, {r6('CASE WHEN abs(l_quantity - 25) > 10 OR l_discount * 200 > 10 THEN 0.0 ELSE l_discount * 200 END')} AS dx FROM lineitem")
def realistic_shifts(spark, sf):
    """Shifts beyond ten pixels are no shifts."""
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("dy"), (F.col("l_discount") * 200).alias("dx"))
    return rounded(R.reject_unrealistic(rows, 10.0), "dy", "dx")


@register("expanded_lines", f"WITH {MOVIE} SELECT movie, frame, px AS row_, {r6('CASE WHEN abs(v * 50) > 10 OR abs(v * 30) > 10 THEN 0.0 ELSE v * 50 END')} AS dy, {r6('CASE WHEN abs(v * 50) > 10 OR abs(v * 30) > 10 THEN 0.0 ELSE v * 30 END')} AS dx FROM movie")
def expanded_lines(spark, sf):
    """Displacements of every line of every frame from arrays, those beyond ten pixels at rest."""
    arrays = {"dy": F.transform("values", lambda v: v * 50), "dx": F.transform("values", lambda v: v * 30)}
    return rounded(M.expand_lines(V.frames(spark, sf).withColumns(arrays), 10.0), "dy", "dx")


@register("seed_neighbourhood_correlations", f"WITH {COV}, s AS (SELECT unnest([18, 27, 0]) AS seed) SELECT CAST(seed AS INTEGER) AS seed, px_i, px_j, {r6('r')} AS r FROM cor, s WHERE abs(px_i % 8 - seed % 8) <= 1 AND abs(px_i // 8 - seed // 8) <= 1 AND abs(px_j % 8 - seed % 8) <= 1 AND abs(px_j // 8 - seed // 8) <= 1")
def seed_neighbourhood_correlations(spark, sf):
    """Stored correlations within three seeds' squares."""
    seeds = spark.createDataFrame([(18,), (27,), (0,)], "px int")
    return rounded(G.seed_neighbourhoods(M.pixel_correlation(covariance(spark, sf)), seeds, 3, H, WIDTH), "r")


def written_stacks(spark, sf, folder: str):
    """The recording as stacks of 16-bit pages, ten thousand to one, a file for each movie; and its files."""
    rows = V.frames(spark, sf).withColumns({"values": F.transform("values", lambda v: v * 10000), "height": F.lit(H), "width": F.lit(WIDTH)})
    stack.write_stacks(rows.withColumn("file", F.format_string("m%05d.tif", "movie")), folder)


def movie_of(path):
    """The number in a stack's name."""
    return C.counter(C.base_name(path)).alias("movie")


def read_exploded(rows):
    """Pixel rows of frame rows from stacks."""
    return rows.select(movie_of(F.col("path")), "frame_in_movie", F.posexplode("values").alias("px", "v"))


@register("stack_frames", f"WITH {MOVIE} SELECT movie, frame_in_movie, px, round(v * 10000) + 0.0 AS v FROM movie WHERE frame_in_movie IN (3, 17, 40) AND movie % 10 = 7")
def stack_frames(spark, sf):
    """Three frames of some movies, read from image stacks by pushed filters on path and frame."""
    folder = new_folder(spark, "stacks")
    written_stacks(spark, sf, folder)
    rows = stack.read_frames(spark, folder, [3, 17, 40])
    return read_exploded(rows.where(F.col("path").endswith("7.tif")))


@register("stack_mean_images", f"WITH {MOVIE} SELECT movie, px, {r6('avg(round(v * 10000))')} AS mean FROM movie GROUP BY ALL")
def stack_mean_images(spark, sf):
    """Mean image of every movie, read from image stacks by ranges of pages."""
    folder = new_folder(spark, "stacks")
    written_stacks(spark, sf, folder)
    pages = stack.read_frames(spark, folder, partition_bytes=1 << 13)
    return rounded(M.mean_image(read_exploded(pages)).select("movie", "px", F.col("mean")), "mean")


@register("stack_event_mean", f"WITH {MOVIE}, {STIM} SELECT CAST(o AS INTEGER) AS offset, px, {r6('avg(round(v * 10000))')} AS mean, count(*) AS n FROM stim, range(-3, 7) t(o) JOIN movie ON frame = key_frame + o GROUP BY o, px")
def stack_event_mean(spark, sf):
    """Event-triggered mean of which only the frames around events are read, from the stacks that hold them."""
    folder = new_folder(spark, "stacks")
    written_stacks(spark, sf, folder)
    manifest, windows = V.manifest(V.frames(spark, sf)), M.event_window(V.stimuli(spark, sf), -3, 6)
    paths = C.listed(spark, folder).select("path", movie_of(F.col("path")))
    near = M.frame_to_file(windows.select("frame").distinct(), manifest).select(F.col("file").alias("movie"), F.col("frame_in_file").alias("frame_in_movie"))
    pages = read_exploded(stack.read_pages(near.join(paths, "movie")))
    shown = pages.join(manifest, "movie").select((F.col("frame_start") + F.col("frame_in_movie")).alias("frame"), "px", "v")
    return rounded(M.event_triggered_mean(shown, V.stimuli(spark, sf), -3, 6), "mean")


SESSIONS = """names AS (SELECT movie, printf('AM%03d', 100 + movie % 3) AS mouse, printf('2401%02d', 1 + (movie // 3) % 2) AS day,
  CASE WHEN movie % 7 = 6 THEN printf('AM100_Slice01_File%03d.tif', movie) ELSE printf('AM%03d_run001_%03d.tif', 100 + movie % 3, movie) END AS name, movie % 4 + 1 AS slices FROM (SELECT DISTINCT movie FROM movie)),
sessions AS (SELECT mouse || '_' || day AS acquisition, name, slices, CAST(row_number() OVER (PARTITION BY mouse, day ORDER BY name) - 1 AS BIGINT) AS place FROM names WHERE movie % 7 <> 6)"""


def written_sessions(spark, sf, folder: str) -> None:
    """Movies as stacks in folders by mouse and day, some under names that are no recording's, each with a scanner header."""
    movie = F.col("movie")
    mouse, run = F.format_string("AM%03d", 100 + movie % 3), F.format_string("AM%03d_run001_%03d.tif", 100 + movie % 3, movie)
    name = F.when(movie % 7 == 6, F.format_string("AM100_Slice01_File%03d.tif", movie)).otherwise(run)
    file = F.concat_ws("/", mouse, F.format_string("2401%02d", 1 + F.expr("movie div 3") % 2), name)
    text = F.format_string("SI4.fastZEnable = true\nSI4.stackNumSlices = %d\nSI4.channelsSave = [1;2]\nSI4.scanFramePeriod = 0.%02d\n", movie % 4 + 1, movie % 4 + 1)
    rows = V.frames(spark, sf).withColumns({"file": file, "description": text, "height": F.lit(H), "width": F.lit(WIDTH)})
    stack.write_stacks(rows.where("frame_in_movie < 3"), folder)


@register("discovered_sessions", f"WITH {MOVIE}, {SESSIONS} SELECT acquisition, name, place AS movie FROM sessions")
def discovered_sessions(spark, sf):
    """Recordings found in a folder tree by patterns of its folders and names."""
    folder = new_folder(spark, "tree")
    written_sessions(spark, sf, folder)
    return C.discover(spark, folder).select("acquisition", "name", "movie")


@register("session_headers", f"WITH {MOVIE}, {SESSIONS} SELECT acquisition, name, CAST(slices AS INTEGER) AS slices, CAST(2 AS INTEGER) AS channels, {r6('slices / 100.0')} AS period FROM sessions WHERE place = 0")
def session_headers(spark, sf):
    """Scanner layout of each acquisition, of which only the header of the first file is read."""
    folder = new_folder(spark, "tree")
    written_sessions(spark, sf, folder)
    layout = C.scanner_layout(tiff.header_fields(stack.first_headers(C.discover(spark, folder).select("acquisition", "path"))))
    return rounded(layout.select("acquisition", C.base_name(F.col("path")).alias("name"), "slices", "channels", "period"), "period")


@register("streamed_bins", f"WITH {BINS}, per AS (SELECT movie, count(DISTINCT bin) AS n FROM bins GROUP BY movie), first AS (SELECT movie, coalesce(sum(n) OVER (ORDER BY movie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM per) SELECT CAST(k + bin AS BIGINT) AS bin, px, {r6('v / 8')} AS v FROM bins JOIN first USING (movie)")
def streamed_bins(spark, sf):
    """Bin means of a recording that arrives in pieces, out of order and partly twice, by a stream that is stopped between."""
    folder, frames = new_folder(spark, "frames"), B.with_lengths(V.frames(spark, sf), "r")
    early = (F.col("movie") + F.col("frame_in_movie")) % 3 == 0
    for part in (frames.where(early), frames.where(~early | (F.col("frame_in_movie") < 5))):
        part.repartition(3).write.mode("append").parquet(f"{folder}/in")
        B.store_bins(B.watch(spark, f"{folder}/in"), 8, f"{folder}/store", f"{folder}/checkpoint", tile=32).awaitTermination()
    return rounded(B.read_bins(spark, f"{folder}/store", 32).select("bin", "px", "v"), "v")


@register("shared_jobs", "SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'error' ELSE 'done' END AS state, CAST(CASE WHEN o_orderstatus <> 'P' THEN 2 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END AS BIGINT) AS entries FROM orders")
def shared_jobs(spark, sf):
    """Orders as jobs of two processors on one folder, each worked on once; failed ones of odd numbers are put in anew and cured."""
    folder = new_folder(spark, "shared")
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("acquisition"))
    orders.repartition(6, "job_id").write.json(f"{folder}/inbox")

    def run(healthy, *names):
        motion = lambda jobs: jobs.select("job_id", (F.lit(healthy) | (F.col("acquisition") != "P")).alias("ok"))
        stages = [("motion", motion, True), ("extraction", lambda jobs: jobs.select("job_id", F.lit(True).alias("ok")), True)]
        running = [J.process(J.watch(spark, f"{folder}/inbox", 2), f"{folder}/manifest", f"{folder}/{n}", stages, claims=f"{folder}/claims") for n in names]
        for query in running:
            query.awaitTermination()

    run(False, "first", "second")
    failed = J.job_states(J.manifest(spark, f"{folder}/manifest"), 2).where("state = 'error' AND job_id % 2 = 1")
    orders.join(failed.select("job_id"), "job_id", "left_semi").write.mode("append").json(f"{folder}/inbox")
    run(True, "first")
    entries = J.manifest(spark, f"{folder}/manifest")
    return J.job_states(entries, 2).join(entries.groupBy("job_id").agg(F.count("*").alias("entries")), "job_id")


@register("file_states", f"WITH {MOVIE}, m AS (SELECT DISTINCT movie FROM movie) SELECT printf('m%05d.tif', movie) AS name, CASE WHEN movie % 3 = 0 THEN 'duplicate' WHEN movie % 3 = 1 THEN 'new' ELSE 'missing' END AS state FROM m UNION ALL SELECT printf('m%05d.tif', movie), 'duplicate' FROM m WHERE movie % 6 = 1 UNION ALL SELECT 'checkpoint.parquet', 'invalid'")
def file_states(spark, sf):
    """Files to be registered: some are known, some are named twice, some are not there, and one is no stack."""
    folder = new_folder(spark, "register")
    written_stacks(spark, sf, folder)
    V.table(spark, sf, "region").coalesce(1).write.parquet(f"{folder}/other")
    other = C.listed(spark, f"{folder}/other").select("path", F.lit("checkpoint.parquet").alias("name")).limit(1)
    files = C.listed(spark, folder).where(F.col("path").endswith(".tif")).select("path", C.base_name(F.col("path")).alias("name"), movie_of(F.col("path")))
    gone = F.when(F.col("movie") % 3 == 2, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path")
    named = files.select(gone, "name", "movie")
    asked = named.unionByName(named.where("movie % 6 = 1")).select("path").unionByName(other.select("path"))
    found = stack.file_states(asked, files.where("movie % 3 = 0").select("path"))
    return found.join(named.select("path", "name").unionByName(other), "path").select("name", "state")


@register("attached_files", f"WITH {MANIFEST} SELECT CAST(movie % 2 AS INTEGER) AS slice, CAST(0 AS INTEGER) AS channel, CAST(row_number() OVER (PARTITION BY movie % 2 ORDER BY 9999 - movie) - 1 AS BIGINT) AS movie, printf('new/m%05d.tif', 9999 - movie) AS path FROM manifest UNION ALL SELECT 2, 0, movie, printf('old/m%05d.tif', movie) FROM manifest")
def attached_files(spark, sf):
    """Corrected files put into a manifest after the fact, two of its three slices."""
    files = V.manifest(V.frames(spark, sf)).select("movie")
    old = files.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("slice"), F.lit(0).alias("channel"), "movie")
    old = old.where("slice = 2 OR movie < 2").withColumn("path", F.format_string("old/m%05d.tif", "movie"))
    new = files.select((F.col("movie") % 2).cast("int").alias("slice"), F.lit(0).alias("channel"), F.format_string("new/m%05d.tif", 9999 - F.col("movie")).alias("path"))
    return C.attach_corrected(old, new)
