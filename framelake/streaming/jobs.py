"""The batch job processor as a stream: a watched folder of job files, a stage machine, a manifest and a log.

A streaming query with a checkpoint owns its input, so one processor reads a job file once.  Several processors on one
folder share it by claims: a file that is created only where none exists, with the owner's name, for each job file; a
processor works on the files that it has claimed, and on those again when a batch is replayed.  Results are appended to a
manifest, in a folder for each owner, by stage and by a slot of the job's number, so a batch reads back the stage and
slots it needs.  A stage that the manifest has as done is skipped, so a replayed batch does no work twice.

A stage that raises fails the jobs of its batch, not the stream: they get the stage's state and the error's text.  What
counts is a job's last attempt at each stage, so a job that is put in anew after an error can end done.  While a stop file is
there, jobs are returned (state ``jobs``) instead of worked on.  Job files that are done with can be moved to an archive.
"""

from __future__ import annotations

import hashlib
import os
import socket
import time
import uuid
import warnings
from collections.abc import Callable, Sequence
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

JOB = "job_id long, acquisition string"
MANIFEST = "job_id long, state string, batch long, attempt string, message string, host string, at timestamp, owner string, stage string, slot int"
#: A stage gets the jobs that still need it and returns (job_id, ok).
Stage = Callable[[DataFrame], DataFrame]
RETURNED = "returned"
SLOTS = 16
#: A claim without a name, left by a processor that died between its two steps, is free after so many seconds.
GRACE = 60.0


def watch(spark: SparkSession, folder: str, most: int = 1, archive: str | None = None) -> DataFrame:
    """Job files of a folder as a stream (``job_id``, ``acquisition``, ``file``), at most ``most`` files a batch; files of
    committed batches are moved to ``archive``."""
    reader = spark.readStream.schema(JOB).option("maxFilesPerTrigger", most)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(folder).select("job_id", "acquisition", F.col("_metadata.file_path").alias("file"))


def slot(job: str = "job_id"):
    """The slot of a job."""
    return F.pmod(F.col(job), F.lit(SLOTS)).cast("int")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest so far."""
    try:
        return spark.read.schema(MANIFEST).option("basePath", path).parquet(path)
    except Exception as missing:  # the first batch finds no folder
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], MANIFEST)


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file exists, on any store that Spark can read."""
    where, system = file_system(spark, path)
    return system.exists(where)


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with a text unless it exists; of several callers one succeeds."""
    where, system = file_system(spark, path)
    if system.getUri().getScheme() == "file":
        # Hadoop's local file system looks first and creates then; the operating system does both at once.
        local = unquote(urlparse(where.toUri().toString()).path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = system.create(where, False)
    except Py4JJavaError as error:
        if "AlreadyExists" not in str(error.java_exception):
            raise
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


def claimant(spark: SparkSession, path: str) -> tuple[str, float]:
    """The owner that a claim names, and its age in seconds."""
    where, system = file_system(spark, path)
    rows = spark.read.text(path).first()
    return (rows.value if rows else ""), time.time() - system.getFileStatus(where).getModificationTime() / 1000


def claim(spark: SparkSession, claims: str, files: Sequence[str], owner: str, grace: float = GRACE) -> list[str]:
    """Those of the job files that belong to ``owner``: claimed now, or before."""
    won = []
    for file in files:
        path = f"{claims}/{hashlib.sha256(file.encode()).hexdigest()}"
        if created(spark, path, owner):
            won.append(file)
            continue
        name, age = claimant(spark, path)
        if not name and age > grace:
            where, system = file_system(spark, path)
            system.delete(where, False)
            if created(spark, path, owner):
                won.append(file)
        elif name == owner:
            won.append(file)
    return won


def release(spark: SparkSession, claims: str, owner: str) -> int:
    """Gives up the claims of a processor that will not come back; its job files can then be put in anew."""
    where, system = file_system(spark, claims)
    if not system.exists(where):
        return 0
    mine = [s.getPath() for s in system.listStatus(where) if claimant(spark, s.getPath().toString())[0] == owner]
    for path in mine:
        system.delete(path, False)
    return len(mine)


def record(found: DataFrame, stage: str, batch: int, path: str, owner: str = "one", attempt: str = "") -> None:
    """Appends (``job_id``, ``state``, ``message``) rows to the manifest, with host and time."""
    rest = [F.lit(batch).cast("long").alias("batch"), F.lit(attempt).alias("attempt"), "message", F.lit(socket.gethostname()).alias("host"), F.current_timestamp().alias("at")]
    rows = found.select("job_id", "state", *rest, F.lit(stage).alias("stage"), slot().alias("slot")).repartition("slot")
    # Writers into one folder would clear away each other's files, so each owner has its own.
    rows.write.mode("append").partitionBy("stage", "slot").parquet(f"{path}/owner={owner}")


def run_batch(jobs: DataFrame, batch: int, path: str, stages: Sequence[tuple[str, Stage, bool]], stop: str | None = None, owner: str = "one", claims: str | None = None) -> None:
    """Runs the stages in turn; a failed job leaves a stage that must succeed (third value) for the error state."""
    spark, attempt = jobs.sparkSession, uuid.uuid4().hex
    if claims is not None:
        files = [r.file for r in jobs.select("file").distinct().collect()]  # at most those of a batch
        jobs = jobs.where(F.col("file").isin(claim(spark, claims, files, owner)))
    alive = jobs.select("job_id", "acquisition").distinct()
    slots = [r.slot for r in alive.select(slot().alias("slot")).distinct().collect()]
    if not slots:
        return
    for name, stage, must in stages:
        if stop is not None and there(spark, stop):
            record(alive.select("job_id", F.lit("jobs").alias("state"), F.lit("stopped").alias("message")), RETURNED, batch, path, owner, attempt)
            return
        own = (F.col("stage") == name) & F.col("slot").isin(slots)
        done = manifest(spark, path).where(own & (F.col("state") == "done")).select("job_id").distinct()
        waiting, bad = alive.join(done, "job_id", "left_anti"), F.lit("error" if must else "logged")
        try:
            found = stage(waiting).select("job_id", F.when(F.col("ok"), "done").otherwise(bad).alias("state"), F.lit(None).cast("string").alias("message"))
            record(found, name, batch, path, owner, attempt)
        except Exception as error:  # whatever a stage raises is its jobs' error
            record(waiting.select("job_id", bad.alias("state"), F.lit(str(error)[:1000]).alias("message")), name, batch, path, owner, attempt)
        if must:
            # What failed in this attempt, not in an earlier one of the same batch.
            failed = manifest(spark, path).where(own & (F.col("owner") == owner) & (F.col("attempt") == attempt) & (F.col("state") == "error"))
            alive = alive.join(failed.select("job_id"), "job_id", "left_anti")


def owner_of(checkpoint: str) -> str:
    """The name of the processor that keeps this checkpoint."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def process(jobs: DataFrame, path: str, checkpoint: str, stages: Sequence[tuple[str, Stage, bool]], poll: str | None = None, stop: str | None = None, claims: str | None = None) -> StreamingQuery:
    """Starts the processor: until the folder is drained, or polling at an interval such as ``60 seconds``.  Processors that
    watch one folder share a manifest and a folder of ``claims``, and each has a checkpoint of its own."""
    owner = owner_of(checkpoint)
    writer = jobs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: run_batch(df, batch, path, stages, stop, owner, claims))
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def job_states(entries: DataFrame, stages: int) -> DataFrame:
    """Where each job stands by its last attempt at each stage: ``error`` if one failed, ``done`` when all ended, ``jobs``
    when it was returned last, else ``inProgress``."""
    turn = F.struct("at", "batch")
    each = entries.groupBy("job_id", "stage").agg(F.max_by("state", turn).alias("state"), F.max(turn).alias("turn"))
    own = F.col("stage") != RETURNED
    counted = each.groupBy("job_id").agg(
        F.max((own & (F.col("state") == "error")).cast("int")).alias("bad"), F.sum((own & (F.col("state") != "error")).cast("int")).alias("n"), F.max_by("stage", "turn").alias("last"),
    )
    state = F.when(F.col("last") == RETURNED, "jobs").when(F.col("bad") == 1, "error").when(F.col("n") >= stages, "done").otherwise("inProgress")
    return counted.select("job_id", state.alias("state"))


def again(jobs: DataFrame, entries: DataFrame, stages: int) -> DataFrame:
    """Jobs that were returned, to be put into the watched folder anew."""
    return jobs.join(job_states(entries, stages).where("state = 'jobs'").select("job_id"), "job_id", "left_semi")


def log_lines(entries: DataFrame) -> DataFrame:
    """Tab-separated log lines of a manifest, numbered for each job: time, host, batch, stage, state, message."""
    parts = [F.date_format("at", "yyyy-MM-dd HH:mm:ss"), "host", F.col("batch").cast("string"), "stage", "state", F.coalesce("message", F.lit(""))]
    order = Window.partitionBy("job_id").orderBy("at", "batch", "stage")
    return entries.select("job_id", F.row_number().over(order).alias("turn"), F.concat_ws("\t", *parts).alias("line"))


def append_log(lines: DataFrame, path: str, wait: float = 60.0) -> bool:
    """Appends log lines as text.  Where that fails it is tried once more after a while, as a network may come back, and then
    left with a warning: a log is no reason to end the work.  Says whether the lines were written."""
    for last in (False, True):
        try:
            lines.select(F.concat_ws("\t", F.col("job_id").cast("string"), "line").alias("value")).write.mode("append").text(path)
            return True
        except Exception as error:  # noqa: BLE001
            warnings.warn(f"log not written{'' if last else ', another try follows'}: {str(error)[:200]}", stacklevel=2)
            if not last:
                time.sleep(wait)
    return False
