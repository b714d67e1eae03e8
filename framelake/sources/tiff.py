"""Uncompressed baseline TIFF stacks as frame rows, read through Spark so that any store it knows will do."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the TIFF 6.0 format: tags, and sizes of the field types that matter here.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, COUNTS, FORMAT = 256, 257, 258, 259, 273, 279, 339
SIZES = {2: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
DESCRIPTION = 270
#: Bytes of a directory that one read fetches; a longer directory takes a second read.
DIRECTORY_READ = 512
#: Frames of a pixel in one row of the pixel-major store.
BLOCK = 4096

#: Rows of frames from stacks.
FRAME_ROWS = "path string, frame_in_movie long, height int, width int, values array<double>"
#: Reads ``n`` bytes (fewer at the end of the file) from a place.
Read = Callable[[int, int], bytes]
Tags = dict[int, tuple[int, ...]]


def directories(read: Read, wanted: Callable[[int], bool] | None = None, stop: int | None = None) -> Iterator[tuple[int, str, Tags]]:
    """(number, byte order, tags) of the wanted images of a stack in turn, up to number ``stop``; text is a tuple of its bytes.

    Of an image that is not wanted only the directory itself is read, for the place of the next one.  Both the classic
    format and the one with 64-bit places are read.
    """
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack_from(order + "H", head, 2)[0] if order is not None and len(head) >= 8 else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    wide = kind == 43
    count_of, place_of, entry = (f"{order}Q", f"{order}Q", 20) if wide else (f"{order}H", f"{order}I", 12)
    leading, inline = struct.calcsize(count_of), struct.calcsize(place_of)
    at = struct.unpack_from(place_of, head, 8 if wide else 4)[0]
    number = 0
    while at and (stop is None or number < stop):
        block = read(at, DIRECTORY_READ)
        n = struct.unpack_from(count_of, block, 0)[0]
        if (size := leading + entry * n + inline) > len(block):
            block = read(at, size)
        if wanted is None or wanted(number):
            tags: Tags = {}
            for k in range(n):
                start = leading + entry * k
                tag, what, count = struct.unpack_from(f"{order}HH{place_of[1:]}", block, start)
                if what in SIZES:
                    letter, width = SIZES[what]
                    place = start + entry - inline
                    held = block[place : place + inline] if width * count <= inline else read(struct.unpack_from(place_of, block, place)[0], width * count)
                    tags[tag] = struct.unpack_from(f"{order}{count}{letter}", held, 0)
            yield number, order, tags
        at = struct.unpack_from(place_of, block, leading + entry * n)[0]
        number += 1


def pixels(read: Read, order: str, tags: Tags) -> np.ndarray:
    """An image from its strips; strips that lie end to end are read at once."""
    if tags.get(COMPRESSION, (1,))[0] != 1:
        raise ValueError("compressed TIFF is not supported")
    runs: list[list[int]] = []
    for a, c in zip(tags[OFFSETS], tags[COUNTS], strict=True):
        if runs and sum(runs[-1]) == a:
            runs[-1][1] += c
        else:
            runs.append([a, c])
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    strips = b"".join(read(a, c) for a, c in runs)
    return np.frombuffer(strips, f"{order}{kind}{tags[BITS][0] // 8}").reshape(tags[HEIGHT][0], tags[WIDTH][0])


def from_bytes(data: bytes) -> Read:
    """Reads of a file that is in memory."""
    return lambda at, n: data[at : at + n]


def pages(read: Read, wanted: Callable[[int], bool] | None = None, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(number, image) of the images of a stack, or of the wanted ones only: the others' pixels are not read."""
    for number, order, tags in directories(read, wanted, stop):
        yield number, pixels(read, order, tags)


def frame_batch(found: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    """(path, number, image) as an Arrow batch of frame rows, values column-major; pixels are never Python objects."""
    sizes = np.array([picture.size for _, _, picture in found])
    values = np.concatenate([picture.T.reshape(-1) for _, _, picture in found]).astype(np.float64, copy=False)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))
    shapes = [pa.array([picture.shape[k] for _, _, picture in found], pa.int32()) for k in (0, 1)]
    names, numbers = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())
    return pa.RecordBatch.from_arrays([names, numbers, *shapes, lists], ["path", "frame_in_movie", "height", "width", "values"])


def stack_bytes(images: list[np.ndarray], description: str = "") -> bytes:
    """A stack of 16-bit images as a file, the description behind the first one's pixels."""
    text = description.encode("latin-1") + b"\0"
    out = bytearray(b"II*\0" + struct.pack("<I", 8))
    for k, picture in enumerate(images):
        pixels = np.ascontiguousarray(picture, "<i2").tobytes()
        tags = [(WIDTH, picture.shape[1]), (HEIGHT, picture.shape[0]), (BITS, 16), (COMPRESSION, 1), (262, 1), (OFFSETS, 0), (277, 1), (278, picture.shape[0]), (COUNTS, len(pixels)), (FORMAT, 2)]
        own = text if description and not k else b""
        if own:
            tags.insert(5, (DESCRIPTION, len(own)))
        start = len(out)
        data = start + 2 + 12 * len(tags) + 4
        after = data + len(pixels) + len(own) if k + 1 < len(images) else 0
        out += struct.pack("<H", len(tags))
        for tag, value in tags:
            out += struct.pack("<HHII", tag, 2, value, data + len(pixels)) if tag == DESCRIPTION else struct.pack("<HHII", tag, 4, 1, data if tag == OFFSETS else value)
        out += struct.pack("<I", after) + pixels + own
    return bytes(out)


def read_stacks(spark: SparkSession, path: str, frames: list[int] | None = None) -> DataFrame:
    """(``path``, ``frame_in_movie``, ``height``, ``width``, ``values`` column-major) of every page of every stack, or of
    the given frames of each: single frames by number, as a mean image or a viewer asks for them.  A filter on ``path``
    leaves out whole files."""
    wanted, stop = (None, None) if frames is None else (set(frames).__contains__, max(frames, default=-1) + 1)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for k, picture in pages(from_bytes(content), wanted, stop):
                    yield frame_batch([(name, k, picture)])

    return files.mapInArrow(of, FRAME_ROWS)


def number_files(frames: DataFrame) -> DataFrame:
    """``movie`` from the order of paths and the global ``frame``: files before count in full."""
    order = Window.orderBy("path")  # one row for each file
    sizes = frames.groupBy("path").agg(F.count("*").alias("z"))
    starts = sizes.select("path", (F.row_number().over(order) - 1).cast("long").alias("movie"), (F.sum("z").over(order) - F.col("z")).alias("start"))
    return frames.join(starts, "path").withColumn("frame", F.col("start") + F.col("frame_in_movie")).drop("start")


def write_pixel_major(movie: DataFrame, path: str) -> None:
    """The pixel-major store: a row for each pixel and block of ``BLOCK`` frames, with its ``frames`` and ``series`` in order,
    clustered by pixel and block for pruning.  A row is bounded however long a recording is."""
    blocks = movie.withColumn("block", F.expr(f"frame div {BLOCK}")).groupBy("px", "block").agg(F.sort_array(F.collect_list(F.struct("frame", "v"))).alias("s"))
    series = blocks.select("px", "block", F.col("s.frame").alias("frames"), F.col("s.v").alias("series"))
    series.repartitionByRange("px", "block").sortWithinPartitions("px", "block").write.mode("overwrite").parquet(path)


def read_pixels(spark: SparkSession, path: str, pixels: list[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """(``px``, ``frame``, ``v``) of some pixels and a range of frames of the pixel-major store; only their blocks are read."""
    rows = spark.read.parquet(path)
    if pixels is not None:
        rows = rows.where(F.col("px").isin(pixels))
    if first is not None:
        rows = rows.where(F.col("block") >= first // BLOCK)
    if last is not None:
        rows = rows.where(F.col("block") <= last // BLOCK)
    out = rows.select("px", F.explode(F.arrays_zip("frames", "series")).alias("s")).select("px", F.col("s.frames").alias("frame"), F.col("s.series").alias("v"))
    return out.where(F.lit(True) & (F.lit(first is None) | (F.col("frame") >= F.lit(first))) & (F.lit(last is None) | (F.col("frame") <= F.lit(last))))


def write_corrected(frames: DataFrame, path: str) -> None:
    """Corrected frames by slice, channel and movie, so that reads prune to the files they need."""
    frames.write.mode("overwrite").partitionBy("slice", "channel", "movie").parquet(path)


def append_bins(bins: DataFrame, path: str, batch: str | None = None) -> None:
    """Bins behind those that a store has already: their numbers go on from its highest ``bin``.

    A ``batch`` that is appended again, as a retried one is, replaces only itself and keeps its numbers' start.  Batches are
    for one writer at a time.
    """
    spark = bins.sparkSession
    batch = uuid.uuid4().hex if batch is None else batch
    try:
        others = spark.read.option("basePath", path).parquet(path)
        own = others.where(F.col("batch") == batch).agg(F.min("first")).first()[0]
        end = own - 1 if own is not None else others.agg(F.max("bin")).first()[0]
    except AnalysisException as missing:  # the first append finds no store
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        end = None
    start = F.lit(0 if end is None else end + 1).cast("long")
    bins.withColumns({"bin": F.col("bin") + start, "first": start}).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_covariance(covariance: DataFrame, path: str, **settings: int) -> None:
    """The covariance band clustered by pixel, with its settings as columns of a one-row table beside it."""
    covariance.repartitionByRange("px_i").sortWithinPartitions("px_i", "px_j").write.mode("overwrite").parquet(f"{path}/band")
    covariance.sparkSession.createDataFrame([tuple(settings.values())], list(settings)).write.mode("overwrite").parquet(f"{path}/settings")


def write_snapshot(regions: DataFrame, path: str, version: int) -> None:
    """The region table as one more version of itself; a version that is written again replaces only itself."""
    regions.write.mode("overwrite").parquet(f"{path}/version={version}")


def description(read: Read) -> str:
    """The description of a stack's first image; a text that fits in its directory stands there, a longer one anywhere."""
    for _, _, tags in directories(read, stop=1):
        return "".join(map(chr, tags.get(DESCRIPTION, ())))
    return ""


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``fields``): the ``name = number`` lines of each stack's description tag, for ``catalog.scanner_layout``.

    A list in brackets counts its items; true and false are 1 and 0.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [description(from_bytes(content)) for content in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(heads, pa.string())], ["path", "head"])

    return header_fields(files.mapInArrow(of, "path string, head string"))


def header_fields(heads: DataFrame) -> DataFrame:
    """``fields`` of descriptions in ``head``, beside the other columns, which tell the stacks apart."""
    lines = F.expr("regexp_extract_all(head, '([A-Za-z][A-Za-z0-9_.]*) *= *([^\\r\\n\\u0000]+)', 0)")
    each = heads.select("*", F.explode(lines).alias("line"))
    name = F.regexp_replace(F.trim(F.element_at(F.split("line", "=", 2), 1)), "^(scanimage|state)\\.", "")
    text = F.lower(F.trim(F.element_at(F.split("line", "=", 2), 2)))
    items = F.size(F.filter(F.split(F.regexp_replace(text, r"[\[\]]", ""), r"[\s;,]+"), lambda s: s != ""))
    number = F.when(text.startswith("["), items.cast("double")).when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))
    rest = [c for c in heads.columns if c != "head"]
    known = each.select(*rest, name.alias("k"), number.alias("v")).where("v IS NOT NULL").groupBy(*rest, "k").agg(F.max("v").alias("v"))
    return known.groupBy(*rest).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields"))
