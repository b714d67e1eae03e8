"""Helpers shared by the training-data operators: shared-storage stages, Arrow text access, learning folds."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python tasks work through an Arrow batch in slices of about this many bytes of text.
SLICE_BYTES = 4 << 20
#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: The folders that ``write_stage`` has written, by the DataFrames that read them.
WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; on a local master only (tests) one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="framelake-"))
    return context.getCheckpointDir()


#: Stages written since each ``run_stage`` that is under way began.
SCOPES: list[list[DataFrame]] = []


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at files that survive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    WRITTEN[out] = path
    if SCOPES:
        SCOPES[-1].append(out)
    return out


def run_stage(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, written; the stages that it wrote on the way are deleted then."""
    SCOPES.append([])
    try:
        out = write_stage(make(), name)
    finally:
        passing = SCOPES.pop()
    for df in passing:
        if df is not out:
            drop_stage(df)
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a written stage that nothing reads any more."""
    path = WRITTEN.pop(df, None)
    if path is not None:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def beside(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(``row``, ``text``): every row as a struct, whatever its columns are called, and its text with null read as empty."""
    return docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"), text_column(text_col).alias("text"))


def quoted(name: str) -> str:
    """A column name that may hold dots, as an expression."""
    return "`" + name.replace("`", "``") + "`"


def text_column(name: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(doc_id: Column, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``: the split that decides what a learner may see.  A null id is fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def fold_in_python(doc_id: object, folds: int = 4) -> int:
    """``fold_of`` for one value, for tests."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, end to end, and the n + 1 offsets into them; nothing is copied."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, (_, where, data) = (np.int64 if wide else np.int32), column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``limit`` bytes in each; a longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            yield batch.slice(start, min(stop, batch.num_rows) - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a batch as UTF-8 bytes."""
    data, offsets = utf8(batch.column(column))
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def bounded_sample(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """``df`` if it has at most ``bound`` rows, else the rows whose key hash lies in a share that gives about 0.95 times
    as many.  ``keys`` must tell rows apart; tasks filter by themselves, and nothing is sorted or gathered."""
    n = df.count()
    if n <= bound:
        return df
    share = int((1 << 40) * 0.95 * bound / n)
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < share)
