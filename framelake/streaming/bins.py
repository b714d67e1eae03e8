"""Downsampled stores that grow as movies arrive: bins of frames as a stateful stream.

Frames come in files, in any order and more than once.  A recording's pixels are cut into tiles, and each (recording,
tile) is a state: the next frame in line, the partial bin's sum and count, how many bins have left, and frames that came
ahead of their turn.  Frames behind the next one have been counted and are dropped, so a replayed file changes nothing; a
movie's last partial bin is dropped when the next movie begins, and bins are numbered on from movie to movie.

State and output commit together with each micro-batch: the checkpoint holds the state, and the store is a file sink, whose
log names the files of committed batches only.  So a stream that is stopped and started anew goes on where it was, and
its store equals ``movie.bin_frames`` over all that has come.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Frames as they arrive; ``z`` is the number of frames of the movie, movies and frames are numbered from 0.
FRAMES = "recording string, movie long, z long, frame_in_movie long, values array<double>"
BINS = "recording string, tile int, bin long, values array<double>"
#: Pixels of a tile.
TILE = 4096
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Binner(StatefulProcessor):
    """Adds a tile's frames in order and gives out its full bins."""

    def __init__(self, n: int, mean: bool) -> None:
        self.n, self.mean = n, mean

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "movie long, frame long, bins long, filled long, total array<double>")
        self.ahead = handle.getMapState("ahead", "movie long, frame long", "z long, values array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        movie, frame, bins, filled, total = self.place.get() if self.place.exists() else (0, 0, 0, 0, None)
        total = None if total is None or not filled else np.array(total, float)
        came = {}
        for batch in rows:
            for m, f, z, values in zip(batch["movie"], batch["frame_in_movie"], batch["z"], batch["values"], strict=True):
                if (m, f) >= (movie, frame):
                    came[int(m), int(f)] = (int(z), values)
        out: list[tuple[int, np.ndarray]] = []
        while True:
            at = (movie, frame)
            if at in came:
                z, values = came.pop(at)
                if self.ahead.containsKey(at):
                    self.ahead.removeKey(at)
            elif self.ahead.containsKey(at):
                z, values = self.ahead.getValue(at)
                self.ahead.removeKey(at)
            else:
                break
            values = np.array(values, float)
            total, filled = (values if total is None else total + values), filled + 1
            if filled == self.n:
                out.append((bins, total / self.n if self.mean else total))
                bins, filled, total = bins + 1, 0, None
            frame += 1
            if frame >= z:
                movie, frame, filled, total = movie + 1, 0, 0, None
        for at, (z, values) in came.items():
            self.ahead.updateValue(at, (z, np.array(values, float).tolist()))
        self.place.update((movie, frame, bins, filled, [] if total is None else total.tolist()))
        if out:
            yield pd.DataFrame({"recording": key[0], "tile": key[1], "bin": [b for b, _ in out], "values": [v.tolist() for _, v in out]})

    def close(self) -> None:
        pass


def watch(spark: SparkSession, folder: str, most: int = 16) -> DataFrame:
    """Frame files of a folder as a stream, at most ``most`` files a batch."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", most).parquet(folder)


def tiles(frames: DataFrame, tile: int = TILE) -> DataFrame:
    """Frames cut into tiles of so many pixels."""
    numbers = F.sequence(F.lit(0), F.expr(f"(size(values) - 1) div {tile}").cast("int"))
    cut = frames.withColumn("tile", F.explode(numbers))
    return cut.withColumn("values", F.slice("values", F.col("tile") * tile + 1, tile))


def binned(frames: DataFrame, n: int, how: str = "avg", tile: int = TILE) -> DataFrame:
    """The bins of ``n`` frames of a stream of frames, in ``BINS``; a pixel that is missing in a frame is missing in its bin."""
    rows = tiles(frames, tile).select("recording", "tile", "movie", "z", "frame_in_movie", "values")
    return rows.groupBy("recording", "tile").transformWithStateInPandas(Binner(n, how == "avg"), BINS, "Append", "None")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that this kind of state needs, for queries that are started within."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def store_bins(frames: DataFrame, n: int, store: str, checkpoint: str, how: str = "avg", tile: int = TILE, poll: str | None = None) -> StreamingQuery:
    """Starts the stream into a store: until what is there is done, or polling at an interval such as ``60 seconds``."""
    with rocks(frames.sparkSession):
        writer = binned(frames, n, how, tile).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start(store)


def read_bins(spark: SparkSession, store: str, tile: int = TILE) -> DataFrame:
    """(``recording``, ``bin``, ``px``, ``v``) of a store."""
    rows = spark.read.schema(BINS).parquet(store).select("recording", "bin", "tile", F.posexplode("values").alias("k", "v"))
    return rows.select("recording", "bin", (F.col("tile") * tile + F.col("k")).alias("px"), "v")


def with_lengths(frames: DataFrame, recording: str) -> DataFrame:
    """Frame rows in ``FRAMES``, with their movies' lengths by a count."""
    lengths = frames.groupBy("movie").agg(F.count("*").alias("z"))
    return frames.join(lengths, "movie").select(F.lit(recording).alias("recording"), "movie", "z", "frame_in_movie", F.col("values").cast("array<double>").alias("values"))


def correct_into_store(frames: DataFrame, recording: str, height: int, width: int, reference_movie: int, folder: str, n: int, strategy: str = "lines_affine") -> DataFrame:
    """A whole-recording strategy with its downsampled store: corrected frames are added to ``<folder>/corrected``, and their
    bins' means to ``<folder>/bins`` by the stream, which takes up what was added since it last ran.

    ``frames`` are whole movies (``movie``, ``frame``, ``frame_in_movie``, ``values``), numbered on from those before; the
    reference movie must be among them.  Returns the store's bins so far.
    """
    from framelake.operators.nonrigid import RECORDING_STRATEGIES, correct_recording

    spark = frames.sparkSession
    fixed = correct_recording(frames, height, width, reference_movie, **RECORDING_STRATEGIES[strategy])
    rows = fixed.join(frames.select("movie", "frame", "frame_in_movie"), ["movie", "frame"])
    with_lengths(rows, recording).write.mode("append").parquet(f"{folder}/corrected")
    store_bins(watch(spark, f"{folder}/corrected"), n, f"{folder}/bins", f"{folder}/checkpoint").awaitTermination()
    return read_bins(spark, f"{folder}/bins")
