"""Shards of near equal bytes by Karmarkar-Karp differencing, with equal texts kept together.

Rows of one text are an indivisible group; its weight is the bytes of all its rows, each text's UTF-8 bytes and one more.
Differencing starts with one partial partition for each item (the item on one side, nothing on the others) and always
combines the two whose sides differ most, the heaviest side of one with the lightest of the other, until one is left:
the differences cancel, so that the last spread is far below that of dealing items out largest first.

The items are groups, as long as a group weighs at least 1 / ``FINEST`` of all bytes (so there are at most ``FINEST`` of
these); lighter groups are bundled within their task, closed at that weight.  So there are at most twice ``FINEST`` items
and one more for each task, however many documents there are.  Only their weights, numbers, reach the driver, and bundles
are so many and so small that they even out what heavy groups leave.  Everything else is joins: rows of heavy groups meet
a broadcast table of at most ``FINEST`` digests, so no hot group is shuffled, and the others are shuffled by digest.

Slots number a shard's rows without a gap: a task counts its own rows of each shard, and the counts of the tasks before
it are its start.

Nulls and edge cases: a null text is an empty one (size 1); any id, null too, is allowed and never read.  Repeated rows are
rows of one group.  A group of more than its share of all bytes fills a shard by itself and the others stay near equal.
Equal texts are told by the 128 bits of their MD5.  An empty table gives no rows; shards may stay empty where there are
fewer groups than shards.  ``shard_documents`` keeps all columns as they are, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import beside, drop_stage, text_column, write_stage

SHARDS = 8
#: A group of at least one in this many of all bytes is an item of its own; lighter groups are bundled up to that weight.
FINEST = 1 << 16
#: Item numbers: the task, a bit for heavy groups, a counter.
TASK_BITS, HEAVY_BIT = 40, 39


def differencing(weights: Sequence[int], sides: int) -> list[int]:
    """The side of each item: partial partitions of largest spread are combined oppositely until one is left."""
    n = len(weights)
    if not n:
        return []
    rest = (0,) * (sides - 1)
    heap = [(-w if sides > 1 else 0, k, (w, *rest)) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    #: For each combined partition its two parts and, by rank of the new sides, the side of the first part.
    made: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a, heavy = heapq.heappop(heap)
        _, b, light = heapq.heappop(heap)
        sums = [x + y for x, y in zip(heavy, reversed(light), strict=True)]
        order = sorted(range(sides), key=lambda i: -sums[i])
        low = sums[order[-1]]
        ranked = tuple(sums[i] - low for i in order)
        heapq.heappush(heap, (-ranked[0], n + len(made), ranked))
        made.append((a, b, order))
    out = [0] * n
    open_nodes = [(heap[0][1], list(range(sides)))]
    while open_nodes:
        node, side_of = open_nodes.pop()
        if node < n:
            out[node] = side_of[0]
            continue
        a, b, order = made[node - n]
        first, second = [0] * sides, [0] * sides
        for rank, i in enumerate(order):
            first[i] = second[sides - 1 - i] = side_of[rank]
        open_nodes += [(a, first), (b, second)]
    return out


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``size``, ``text_crc32``, ``digest``) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_column(text_col).alias("text"))
    size = (F.octet_length("text") + 1).cast("long")
    return rows.select("doc_id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), digest().alias("digest"))


def digest(text_col: str = "text"):
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.col(text_col).cast("binary")))


def bundled(groups: DataFrame, least: int) -> DataFrame:
    """(``digest``, ``weight``, ``item``): groups of at least ``least`` alone, lighter ones in bundles of about that weight."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << TASK_BITS
        heavy_seen = light_sum = 0
        for batch in batches:
            weights = batch.column(1).to_numpy()
            heavy = weights >= least
            filled = light_sum + np.cumsum(np.where(heavy, 0, weights))
            single = (1 << HEAVY_BIT) + heavy_seen + np.cumsum(heavy) - 1
            items = task + np.where(heavy, single, (filled - 1) // least)
            if len(weights):
                light_sum, heavy_seen = int(filled[-1]), heavy_seen + int(heavy.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items.astype(np.int64))], ["digest", "weight", "item"])

    return groups.select("digest", "weight").mapInArrow(of, "digest binary, weight long, item long")


class GroupShards:
    """The shard of every group, split into heavy and light groups, and how to give rows theirs."""

    def __init__(self, rows: DataFrame, shards: int, finest: int = FINEST) -> None:
        spark = rows.sparkSession
        total = rows.agg(F.sum("size")).first()[0] or 0
        self.least = max(1, -(-total // finest))
        groups = rows.groupBy("digest").agg(F.sum("size").alias("weight"))
        self.groups = write_stage(bundled(groups, self.least), "groups")
        # At most 2 * finest items and one for each task.
        items = sorted(self.groups.groupBy("item").agg(F.sum("weight").alias("w")).collect(), key=lambda r: (-r.w, r.item))
        sides = differencing([r.w for r in items], shards)
        table = pa.table({"item": pa.array([r.item for r in items], pa.int64()), "shard": pa.array(sides, pa.int32())})
        self.items = F.broadcast(spark.createDataFrame(table))
        self.spread = [sum(r.w for r, s in zip(items, sides, strict=True) if s == k) for k in range(shards)]

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows``, which have a ``digest``, with their ``shard``."""
        placed = self.groups.join(self.items, "item")
        heavy = F.broadcast(placed.where(F.col("weight") >= self.least).select("digest", "shard"))
        light = placed.where(F.col("weight") < self.least).select("digest", "shard")
        others = rows.join(heavy.select("digest"), "digest", "left_anti")
        return rows.join(heavy, "digest").unionByName(others.join(light, "digest"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a gapless ``slot`` in each ``shard``: no shard is gathered or sorted."""
    schema = T.StructType([*rows.schema, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            shards = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            local = np.zeros(len(shards), np.int64)
            for s in np.unique(shards).tolist():
                own = np.flatnonzero(shards == s)
                local[own] = seen.get(s, 0) + np.arange(len(own))
                seen[s] = seen.get(s, 0) + len(own)
            parts = pa.array(np.full(len(shards), part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(local)], schema.names)

    placed = write_stage(rows.mapInArrow(of, schema), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part")  # one row for each task
    starts = counts.select("shard", "part", (F.sum("n").over(before) - F.col("n")).alias("first"))
    return placed.join(starts, ["shard", "part"]).withColumn("slot", F.col("first") + F.col("local")).drop("part", "local", "first")


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", finest: int = FINEST) -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot``."""
    rows = write_stage(sized(docs, id_col, text_col), "sized")
    found = GroupShards(rows, shards, finest)
    placed = numbered(found.of(rows).drop("digest"))
    # The placed rows are written, so what they came from is not read any more.
    drop_stage(found.groups)
    drop_stage(rows)
    return placed


def shard_documents(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", finest: int = FINEST) -> DataFrame:
    """(``row``, ``shard``): every row of ``docs`` as a struct, with its shard."""
    rows = beside(docs, text_col)
    weighed = rows.select((F.octet_length("text") + 1).cast("long").alias("size"), digest().alias("digest"))
    found = GroupShards(weighed, shards, finest)
    return found.of(rows.select("row", digest().alias("digest"))).select("row", "shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text_col: str = "text") -> None:
    """One folder of Parquet files for each shard, with the rows of ``docs`` as structs."""
    shard_documents(docs, shards, text_col).write.mode("overwrite").partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """Contract query of operator 13."""
    found = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
