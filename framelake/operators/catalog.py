"""Operators on recording catalogues: naming, listing, paths, sizes, job states.  All native."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def output_name(acquisition: Column, slice_: Column, channel: Column, movie: Column) -> Column:
    """Name of a corrected stack: ``<name>_Slice01_Channel01_File001.tif``."""
    return F.format_string("%s_Slice%02d_Channel%02d_File%03d.tif", acquisition, slice_, channel, movie)


def base_name(path: Column) -> Column:
    """The part of a path after its last separator of either kind."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def move_to(path: Column, folder: str) -> Column:
    """The path with its folder replaced and its file name kept."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), base_name(path))


def prefix(name: Column, mark: str = "_", last: bool = False) -> Column:
    """The name before the first (or last) mark; all of it without one."""
    if not last:
        return F.substring_index(name, mark, 1)
    parts = F.split(name, f"[{mark}]")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), mark)).otherwise(name)


def counter(name: Column) -> Column:
    """The last run of digits in a name as a number, or null."""
    return F.regexp_extract(name, r"([0-9]+)[^0-9]*$", 1).try_cast("bigint")


def before_gap(files: DataFrame, group: str, number: str, most: int = 1) -> DataFrame:
    """Files of each group whose counters run on from the smallest without a gap of more than ``most``."""
    order = Window.partitionBy(group).orderBy(number)
    step = files.withColumn("__gap", (F.col(number) - F.lag(number).over(order) > most).cast("int"))
    return step.withColumn("__gaps", F.sum(F.coalesce("__gap", F.lit(0))).over(order)).where("__gaps = 0").drop("__gap", "__gaps")


def whole_tens(files: DataFrame, group: str, order_by: str, unit: int = 10) -> DataFrame:
    """Each group's files in order, cut to a multiple of ``unit``."""
    whole, order = Window.partitionBy(group), Window.partitionBy(group).orderBy(order_by)
    keyed = files.withColumn("__n", F.count("*").over(whole)).withColumn("__k", F.row_number().over(order))
    return keyed.where(F.col("__k") <= F.floor(F.col("__n") / unit) * unit).drop("__n", "__k")


def same_size_runs(files: DataFrame, group: str, order_by: str, size: str) -> DataFrame:
    """``measure``: whether a file must be measured because its byte length differs from the file before it."""
    before = F.lag(size).over(Window.partitionBy(group).orderBy(order_by))
    return files.withColumn("measure", before.isNull() | (before != F.col(size)))


def register_files(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Found paths that the manifest does not have yet, each once."""
    return found.select("path").distinct().join(manifest.select("path"), "path", "left_anti")


def attach_corrected(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """A manifest (``slice``, ``channel``, ``movie``, ``path``) with corrected files (``slice``, ``channel``, ``path``) put in:
    a channel's files in the order of their names are its movies, in place of those that it had."""
    order = Window.partitionBy("slice", "channel").orderBy(base_name(F.col("path")), "path")
    new = found.select("slice", "channel", "path").distinct().withColumn("movie", (F.row_number().over(order) - 1).cast("long"))
    kept = manifest.join(new.select("slice", "channel", "movie"), ["slice", "channel", "movie"], "left_anti")
    return kept.select("slice", "channel", "movie", "path").unionByName(new.select("slice", "channel", "movie", "path"))


def processing_order(files: DataFrame, reference: int) -> DataFrame:
    """Files with the reference movie first and the others in order."""
    return files.withColumn("turn", F.when(F.col("movie") == reference, 0).otherwise(F.col("movie") + 1))


def pending(jobs: DataFrame, done: DataFrame, stage: str) -> DataFrame:
    """Jobs without a result of this stage."""
    return jobs.join(done.where(F.col("stage") == stage).select("job_id"), "job_id", "left_anti")


def next_job(jobs: DataFrame) -> DataFrame:
    """The first waiting job."""
    return jobs.where("state = 'jobs'").orderBy("job_id").limit(1)


def valid_identifier(name: Column) -> Column:
    """A name with everything but letters, digits and ``_`` replaced, never starting with a digit."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike("^[A-Za-z]"), clean).otherwise(F.concat(F.lit("x"), clean))


def session_counts(files: DataFrame, group: str, unit: int = 10) -> DataFrame:
    """Files of each session, and ``odd`` where they are no multiple of ``unit``."""
    return files.groupBy(group).agg(F.count("*").alias("n")).withColumn("odd", F.col("n") % unit != 0)


#: Ways to name outputs, and to set up a session's acquisitions from its files, by name; users add their own.
NAMERS: dict[str, Callable[..., Column]] = {"slice_channel_file": output_name}
INITIALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_namer(name: str, namer: Callable[..., Column]) -> None:
    """Adds a naming function of (acquisition, slice, channel, movie) columns."""
    NAMERS[name] = namer


def register_initialiser(name: str, initialise: Callable[[DataFrame], DataFrame]) -> None:
    """Adds an initialiser: from files (``session``, ``path``) to files with ``acquisition`` and ``movie``."""
    INITIALISERS[name] = initialise


def by_prefix(files: DataFrame) -> DataFrame:
    """The acquisition is the name before the last ``_``, the movie the order of its counter."""
    named = files.withColumn("acquisition", prefix(base_name(F.col("path")), last=True)).withColumn("__c", counter(base_name(F.col("path"))))
    order = Window.partitionBy("session", "acquisition").orderBy("__c", "path")
    return named.withColumn("movie", (F.row_number().over(order) - 1).cast("long")).drop("__c")


register_initialiser("by_prefix", by_prefix)


def initialise_sessions(files: DataFrame, initialiser: str = "by_prefix", namer: str = "slice_channel_file", slices: int = 1, channels: int = 1) -> DataFrame:
    """All sessions at once: every file with its acquisition and movie, and a row with an ``output`` name for each slice and
    channel."""
    own = INITIALISERS[initialiser](files)
    own = own.withColumn("slice", F.explode(F.sequence(F.lit(1), F.lit(slices)))).withColumn("channel", F.explode(F.sequence(F.lit(1), F.lit(channels))))
    return own.withColumn("output", NAMERS[namer](F.col("acquisition"), F.col("slice"), F.col("channel"), F.col("movie") + 1))


def session_batch(files: DataFrame, group: str, number: str, unit: int = 10, most: int = 1) -> DataFrame:
    """What a batch over all sessions works on: each session's files up to the first gap, in whole units."""
    return whole_tens(before_gap(files, group, number, most), group, number, unit)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(``path``, ``length``, ``modified``) of all files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def discover(spark: SparkSession, folder: str, mouse: str = "[A-Z]{2}[0-9]{3}", date: str = "[0-9]{6}", movie: str = r"[A-Z]{2}[0-9]{3}_.*[0-9]{3}_[0-9]{3,}\.tif") -> DataFrame:
    """Movies of a folder tree ``.../<mouse>/<date>/<movie>``: ``session`` and ``acquisition`` (``<mouse>_<date>``), ``path``,
    ``name``, ``length`` in bytes, ``modified``, and ``movie``, the place among the acquisition's names.

    The tree is listed by Spark on any store that it knows, and no file is opened.  Folders and names must match the patterns
    as a whole, so notes, processed files and other folders are left out.
    """
    files = listed(spark, folder)
    parts = F.split("path", "/")
    named = files.select("*", F.element_at(parts, -1).alias("name"), F.try_element_at(parts, F.lit(-2)).alias("__date"), F.try_element_at(parts, F.lit(-3)).alias("__mouse"))
    named = named.where(F.col("name").rlike(f"^(?:{movie})$") & F.col("__date").rlike(f"^(?:{date})$") & F.col("__mouse").rlike(f"^(?:{mouse})$"))
    named = named.withColumn("acquisition", F.concat_ws("_", "__mouse", "__date")).withColumn("session", F.col("acquisition")).drop("__date", "__mouse")
    order = Window.partitionBy("acquisition").orderBy("name", "path")
    return named.withColumn("movie", (F.row_number().over(order) - 1).cast("long"))


def write_catalog(files: DataFrame, path: str, acquisition: str) -> None:
    """Saves the manifest of one acquisition; saving it again replaces only itself."""
    files.drop("acquisition").write.mode("overwrite").parquet(f"{path}/acquisition={acquisition}")


def read_catalog(spark: SparkSession, path: str, acquisition: str | None = None) -> DataFrame:
    """The saved manifests, or one acquisition's (only its files are read)."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows if acquisition is None else rows.where(F.col("acquisition") == acquisition)


#: Where each generation of scanner header keeps (stack switch, slices, flyback, channels, frame period), newest first.
SCANNER_FIELDS = [
    ("hFastZ.enable", "hFastZ.numFramesPerVolume", "hFastZ.discardFlybackFrames", "hChannels.channelSave", "hRoiManager.scanFramePeriod"),
    ("SI4.fastZEnable", "SI4.stackNumSlices", "SI4.fastZDiscardFlybackFrames", "SI4.channelsSave", "SI4.scanFramePeriod"),
    ("SI.hFastZ.enable", "SI.hFastZ.numFramesPerVolume", "SI.hFastZ.discardFlybackFrames", "SI.hChannels.channelSave", "SI.hRoiManager.scanFramePeriod"),
    ("SI5.fastZEnable", "SI5.stackNumSlices", "SI5.fastZDiscardFlybackFrames", "SI5.channelsSave", "SI5.scanFramePeriod"),
    ("", "", "", "acq.numberOfChannelsSave", ""),
]


def scanner_layout(meta: DataFrame, period: float | None = None) -> DataFrame:
    """``stack``, ``channels``, ``slices`` (without flyback), ``flyback`` and ``period`` from headers of any generation.

    ``meta`` has a map ``fields`` from header names to numbers, channels as their count.  ``period`` stands in for a frame
    period that the header lacks; a header of no known generation fails the row.
    """
    pick = [[F.try_element_at("fields", F.lit(name)) for name in names] for names in SCANNER_FIELDS]
    stack = F.coalesce(*[p[0] for p in pick], F.lit(0.0)) > 0
    channels = F.coalesce(*[p[3] for p in pick], F.raise_error(F.lit("unknown scanner header")).cast("double"))
    slices, flyback = F.coalesce(*[p[1] for p in pick], F.lit(1.0)), F.when(stack, F.coalesce(*[p[2] for p in pick], F.lit(0.0))).otherwise(0.0)
    per_volume = F.coalesce(pick[0][1], pick[2][1]).isNotNull()  # these headers count flyback frames as slices
    kept = F.when(stack & per_volume, slices - flyback).when(per_volume, 1.0).otherwise(slices)
    rest = [c for c in meta.columns if c != "fields"]
    seconds = F.coalesce(*[p[4] for p in pick], F.lit(period).cast("double"))
    return meta.select(*rest, stack.alias("stack"), channels.cast("int").alias("channels"), kept.cast("int").alias("slices"), flyback.cast("int").alias("flyback"), seconds.alias("period"))
