"""TIFF stacks as a data source that reads and writes single pages.

``read_frames(spark, folder)`` gives one row for each page.  A partition is a range of pages of one file, so a stack of any
size is read by many tasks, and filters on ``path`` and ``frame_in_movie`` reach the reader: files and ranges without a
wanted page are no partitions, and within a range only the small directories of the pages before a wanted one are read,
never their pixels.  (``spark.read.format("imagestack").load(folder)`` reads all pages; filters are pushed into it only with
``filters``, see ``read_frames``.)  ``df.write.format("imagestack")`` writes files of pages in the format with 64-bit
places; a page is written once the next one is known, so a task holds one page, and files appear when the job commits.

Files are opened through Arrow's file systems (local and mounted paths, S3, GCS, HDFS).  ``read_frames`` falls back on
``tiff.read_stacks``, which reads whole files through Spark, for stores that Arrow does not know.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from . import tiff

FORMAT = "imagestack"
#: Bytes of pixels that a partition holds, and that an Arrow batch of frames does.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path within it, and what makes a path of it a full one again."""
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
        scheme = path.split(":", 1)[0]
        return system, inner, "file:" if scheme == "file" else f"{scheme}://"
    return fs.LocalFileSystem(), path, "file:"


def reads_of(file: pa.NativeFile) -> tiff.Read:
    """Ranged reads of an open file."""
    return lambda at, n: file.read_at(n, at)


def files_of(path: str) -> list[tuple[str, int]]:
    """(full path, bytes) of a file, of a folder's stacks, or of those that a pattern in the last part names, by name."""
    system, inner, prefix = opened(path.rstrip("/"))
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(prefix + info.path, info.size)]
    folder, pattern = inner, "*.tif*"
    if info.type == fs.FileType.NotFound and any(c in inner.rpartition("/")[2] for c in "*?["):
        folder, _, pattern = inner.rpartition("/")
    found = system.get_file_info(fs.FileSelector(folder))
    return sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File and fnmatch(i.base_name, pattern) and not i.base_name.startswith(("_", ".")))


@dataclass
class Pages(InputPartition):
    """Pages ``first`` to ``end`` (to the last one where it is None) of some files."""

    files: list[str]
    first: int
    end: int | None


class StackReader(DataSourceReader):
    """Reads ranges of pages."""

    def __init__(self, path: str, partition_bytes: int) -> None:
        self.path, self.partition_bytes = path, partition_bytes
        self.least, self.most = 0, None
        self.frames: set[int] | None = None
        self.names: list[Filter] = []

    def _named(self, path: str) -> bool:
        tests = {EqualTo: lambda v: path == v, In: lambda v: path in v, StringStartsWith: path.startswith, StringEndsWith: path.endswith}
        return all(tests[type(f)](f.value) for f in self.names if type(f) in tests)

    def wanted(self, number: int) -> bool:
        """Whether the filters want a page."""
        return number >= self.least and (self.most is None or number <= self.most) and (self.frames is None or number in self.frames)

    def last(self) -> int | None:
        """The highest page that the filters may want, where there is one."""
        ends = [e for e in (self.most, max((f for f in self.frames if f is not None), default=-1) if self.frames is not None else None) if e is not None]
        return min(ends, default=None)

    def partitions(self) -> Sequence[InputPartition]:
        """Small files share a partition, large ones are cut by pages; the pages' size is that of the first file's first."""
        files = [(p, n) for p, n in files_of(self.path) if self._named(p)]
        last = self.last()
        if not files or (last is not None and last < self.least):
            return [Pages([], 0, 0)]
        system, inner, _ = opened(files[0][0])
        with system.open_input_file(inner) as file:
            _, _, tags = next(tiff.directories(reads_of(file), stop=1), (0, "<", {}))
        step = max(1, self.partition_bytes // max(1, sum(tags.get(tiff.COUNTS, (1,)))))
        page = max(1, sum(tags.get(tiff.COUNTS, (1,))))
        out: list[InputPartition] = []
        held, size = [], 0
        for path, n in files:
            if n <= self.partition_bytes:
                if held and size + n > self.partition_bytes:
                    out.append(Pages(held, 0, None))
                    held, size = [], 0
                held, size = [*held, path], size + n
                continue
            # The count of pages is an estimate; the last range is open.
            starts = range(0, max(1, n // page), step)
            for first in starts:
                end = None if first == starts[-1] else first + step
                range_of = range(max(first, self.least), first + step if end is not None else (last or first) + 1)
                if end is None or (any(f in range_of for f in self.frames) if self.frames is not None else (last is None or first <= last) and end > self.least):
                    out.append(Pages([path], first, end))
        return [*out, Pages(held, 0, None)] if held else out or [Pages([], 0, 0)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        last = self.last()
        stop = min((s for s in (partition.end, None if last is None else last + 1) if s is not None), default=None)
        held, size = [], 0
        for path in partition.files:
            system, inner, _ = opened(path)
            with system.open_input_file(inner) as file:
                for number, picture in tiff.pages(reads_of(file), lambda k: k >= partition.first and self.wanted(k), stop):
                    held.append((path, number, picture))
                    size += picture.size * 8
                    if size >= BATCH_BYTES:
                        yield tiff.frame_batch(held)
                        held, size = [], 0
        if held:
            yield tiff.frame_batch(held)


class FilteredReader(StackReader):
    """Takes over the filters that it can answer for."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if f.attribute == ("frame_in_movie",) and self._frame(f) or f.attribute == ("path",) and isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith | IsNotNull):
                if f.attribute == ("path",):
                    self.names.append(f)
            else:
                yield f

    def _frame(self, f: Filter) -> bool:
        """Takes over a condition on the page number, where it can."""
        if isinstance(f, EqualTo | In):
            own = set(f.value) if isinstance(f, In) else {f.value}
            self.frames = own if self.frames is None else self.frames & own
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.least = max(self.least, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, LessThan | LessThanOrEqual):
            last = f.value - isinstance(f, LessThan)
            self.most = last if self.most is None else min(self.most, last)
        else:
            return isinstance(f, IsNotNull)
        return True


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are and where they are to be."""

    moves: list[tuple[str, str]]


class StackWriter(DataSourceArrowWriter):
    """Writes the rows of a partition as stacks: successive rows with one ``file`` are the pages of that file in turn."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, kind: str) -> None:
        self.path, self.overwrite, self.kind = path.rstrip("/"), overwrite, np.dtype(kind)
        self.names = schema.names
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder, _ = opened(self.path)
        scratch = f"{folder}/_writing-{self.job}/{uuid.uuid4().hex}"
        system.create_dir(scratch)
        moves: list[tuple[str, str]] = []
        sink: PageSink | None = None
        for batch in iterator:
            columns = [batch.column(self.names.index(c)).to_pylist() for c in ("file", "height", "width")]
            texts = batch.column(self.names.index("description")).to_pylist() if "description" in self.names else [None] * batch.num_rows
            values = batch.column(self.names.index("values"))
            for k, (name, height, width, text) in enumerate(zip(*columns, texts, strict=True)):
                if sink is None or sink.name != name:
                    if sink is not None:
                        sink.close()
                    moves.append((f"{scratch}/{len(moves)}", f"{folder}/{name}"))
                    sink = PageSink(name, system.open_output_stream(moves[-1][0]), text)
                pixels = values[k].values.to_numpy(zero_copy_only=False).reshape(width, height).T
                if np.issubdtype(self.kind, np.integer):
                    limits = np.iinfo(self.kind)
                    # Half away from zero, as ``compat.to_int16`` does.
                    pixels = np.clip(np.trunc(np.nan_to_num(pixels) + np.copysign(0.5, pixels)), limits.min, limits.max)
                sink.add(np.ascontiguousarray(pixels, self.kind))
        if sink is not None:
            sink.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder, _ = opened(self.path)
        moves = [m for message in messages if message is not None for m in message.moves]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("rows of one file were in several partitions, or not together in one")
        if self.overwrite:
            for path, _ in files_of(self.path):
                system.delete_file(opened(path)[1])
        for below in {b.rpartition("/")[0] for _, b in moves} - {folder}:
            system.create_dir(below)
        for a, b in moves:
            system.move(a, b)
        system.delete_dir(f"{folder}/_writing-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder, _ = opened(self.path)
        if system.get_file_info(f"{folder}/_writing-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_writing-{self.job}")


class PageSink:
    """One stack being written: a page's directory and pixels follow when it is known whether another page comes."""

    def __init__(self, name: str, out: pa.NativeFile, text: str | None = None) -> None:
        self.name, self.out, self.at = name, out, 16
        self.text = b"" if text is None else text.encode("latin-1", "replace") + b"\0"
        self.waiting: np.ndarray | None = None
        self.out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))

    def add(self, picture: np.ndarray) -> None:
        if self.waiting is not None:
            self._put(self.waiting, True)
        self.waiting = picture

    def close(self) -> None:
        if self.waiting is not None:
            self._put(self.waiting, False)
        self.out.close()

    def _put(self, picture: np.ndarray, more: bool) -> None:
        kind = {"u": 1, "i": 2, "f": 3}[picture.dtype.kind]
        tags = [
            (tiff.WIDTH, picture.shape[1]), (tiff.HEIGHT, picture.shape[0]), (tiff.BITS, 8 * picture.itemsize), (tiff.COMPRESSION, 1), (262, 1),
            (tiff.OFFSETS, 0), (277, 1), (278, picture.shape[0]), (tiff.COUNTS, picture.nbytes), (tiff.FORMAT, kind),
        ]
        text, self.text = self.text, b""  # the first page has it
        if text:
            tags.insert(5, (tiff.DESCRIPTION, len(text)))
        data = self.at + 8 + 20 * len(tags) + 8
        after = data + picture.nbytes + (len(text) if len(text) > 8 else 0)
        out = [struct.pack("<Q", len(tags))]
        for tag, value in tags:
            if tag == tiff.DESCRIPTION:  # up to eight bytes stand in the directory itself
                place = struct.pack("<Q", data + picture.nbytes) if value > 8 else text.ljust(8, b"\0")
                out.append(struct.pack("<HHQ", tag, 2, value) + place)
            else:
                out.append(struct.pack("<HHQQ", tag, 16, 1, data if tag == tiff.OFFSETS else value))
        self.out.write(b"".join([*out, struct.pack("<Q", after if more else 0), picture.tobytes(), text if len(text) > 8 else b""]))
        self.at = after


class ImageStack(DataSource):
    """The ``imagestack`` format.  Options: ``path``, ``partitionBytes``, ``filters``, and for writing ``pixels`` (a type
    such as ``<i2``)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return tiff.FRAME_ROWS

    def reader(self, schema: T.StructType) -> StackReader:
        kind = FilteredReader if self.options.get("filters") == "true" else StackReader
        return kind(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> StackWriter:
        return StackWriter(self.options["path"], schema, overwrite, self.options.get("pixels", "<i2"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and turns on the session's filters for such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageStack)


def known(path: str) -> bool:
    """Whether Arrow can open a path's store."""
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def read_frames(spark: SparkSession, path: str, frames: list[int] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Frame rows of the stacks of a path, all or those of some numbers, by ranged reads where the store allows them.

    Spark keeps what a source's reader was last told for a DataFrame, and asks again only for a query with a filter; so the
    rows come with a filter that holds for all of them, or a later query without one would get the filters before it.
    """
    if not known(path):
        return tiff.read_stacks(spark, path, frames)
    register(spark)
    rows = spark.read.format(FORMAT).option("filters", "true").option("partitionBytes", partition_bytes).load(path).where("frame_in_movie >= 0")
    return rows if frames is None else rows.where(F.col("frame_in_movie").isin(frames))


def read_pages(wanted: DataFrame, block: int = 256) -> DataFrame:
    """Frame rows of single pages: ``wanted`` has rows (``path``, ``frame_in_movie``) with full paths, pages beyond a
    stack's end have no row.  Wanted pages are dealt out by file and range of pages, so a hot file is read by many tasks,
    and a task reads its pages in order."""
    keyed = wanted.select("path", F.col("frame_in_movie").cast("long")).where("frame_in_movie >= 0").distinct()
    dealt = keyed.repartition("path", F.expr(f"frame_in_movie div {block}")).sortWithinPartitions("path", "frame_in_movie")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages: dict[str, set[int]] = {}
            for path, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pages.setdefault(path, set()).add(number)
            for path, numbers in pages.items():
                system, inner, _ = opened(path)
                with system.open_input_file(inner) as file:
                    for number, picture in tiff.pages(reads_of(file), numbers.__contains__, max(numbers) + 1):
                        yield tiff.frame_batch([(path, number, picture)])

    return dealt.mapInArrow(of, tiff.FRAME_ROWS)


def write_stacks(frames: DataFrame, path: str, file_col: str = "file", pixels: str = "<i2") -> None:
    """Frame rows (``values`` column-major, ``height``, ``width``, ``frame_in_movie``) as one stack for each file name, which
    may name folders below ``path``.  A file's first page gets the ``description`` of its row, where there is such a column."""
    register(frames.sparkSession)
    rows = frames.withColumn("file", F.col(file_col)).repartition("file").sortWithinPartitions("file", "frame_in_movie")
    text = ["description"] if "description" in frames.columns else []
    rows.select("file", "height", "width", *text, F.col("values").cast("array<double>").alias("values")).write.format(FORMAT).mode("append").option("pixels", pixels).save(path)


def first_headers(files: DataFrame) -> DataFrame:
    """(``acquisition``, ``path``, ``head``): the description of the first file of each acquisition, by path; of a file
    only the first directory and the description itself are read, of the other files nothing."""
    firsts = files.groupBy("acquisition").agg(F.min("path").alias("path"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for path in batch.column("path").to_pylist():
                system, inner, _ = opened(path)
                with system.open_input_file(inner) as file:
                    heads.append(tiff.description(reads_of(file)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.string())], ["acquisition", "path", "head"])

    kind = firsts.schema["acquisition"].dataType.simpleString()
    return firsts.mapInArrow(of, f"acquisition {kind}, path string, head string")


def file_states(paths: DataFrame, manifest: DataFrame) -> DataFrame:
    """``state`` of each of the paths: ``duplicate`` where the manifest has it or an earlier row did, else ``missing``,
    ``invalid`` (there, but no stack), or ``new``.  Of a file its first directory is read."""
    once = paths.groupBy("path").agg(F.count("*").alias("n")).join(manifest.select("path", F.lit(True).alias("had")).distinct(), "path", "left")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = []
            for path in batch.column("path").to_pylist():
                system, inner, _ = opened(path)
                state = "missing"
                if system.get_file_info(inner).type == fs.FileType.File:
                    with system.open_input_file(inner) as file:
                        try:
                            state = "new" if next(tiff.directories(reads_of(file), stop=1), None) else "invalid"
                        except (ValueError, struct.error, KeyError):
                            state = "invalid"
                states.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.string())], ["path", "n", "had", "found"])

    seen = once.mapInArrow(of, "path string, n long, had boolean, found string")
    turn = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    each = seen.select("path", "had", "found", turn.alias("turn"))
    return each.select("path", "turn", F.when(F.col("had") | ((F.col("turn") > 1) & (F.col("found") == "new")), "duplicate").otherwise(F.col("found")).alias("state"))
