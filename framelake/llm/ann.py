"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

The coarse centroids (the square root of the number of vectors) and the residual codebooks are fitted on at most about
``SAMPLE`` vectors (a seeded sample).  Every vector is then indexed: its nearest centroid, and one byte for each group of
dimensions of its residual.  Queries are compared with the vectors of the cells nearest to them by asymmetric distances - a
query's table of products with every codeword, so nothing but the vectors is quantised - and the best are reranked with
exact distances in double precision.

How many cells are probed and which share is reranked is measured, not assumed: ``HELD`` vectors of the sample, kept out
of the fit, are searched for in the rest by brute force, and both are set so that ``recall`` of their neighbours would be
found.  Clustered vectors need a few cells; vectors without clusters, whose neighbours lie in any cell, need most.

Cells are dealt into shards of at most ``SHARD`` vectors and ``SHARD_BYTES``, near cells together; a larger cell is split
over several.  A query is stored once, with the list of its shards, and sent to them.  Both kinds of rows are shuffled by
shard and sorted, a shard's vectors ahead of its queries, so that a task holds the vectors of one shard and lets the
queries stream by, however many they are; a shard is sent a second time only for every ``QUERIES`` of them, so that a
shard which all ask does not stay one task.  Each gives its k nearest for a query; a window with a group limit leaves the
k best.  Nothing but the sample, the counts of the cells and the fitted index passes the driver.

Nulls and edge cases: vectors that are null, all zero, of another length than the most common one (smallest among
equally common), or that hold a null or non-finite number take no part, nor do null ids.  Ties go to the smaller id.
Repeated vectors are separate candidates; a query's own id is left out.  Fewer candidates than ``k`` give fewer rows;
an empty table gives none.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_stage

NEIGHBOURS, SAMPLE, HELD, RECALL = 10, 20_000, 200, 0.97
#: Most vectors of a shard and their bytes; fewer vectors are dealt into ``SHARDS`` shards of at least ``LEAST``.
SHARD, SHARD_BYTES, SHARDS, LEAST = 1 << 16, 1 << 26, 64, 2048
#: Queries that pass by one copy of a shard.
QUERIES = 1 << 18
DIMS_A_CODE, CODES = 4, 256
#: Queries whose distances are held at a time, and their nearest cells, whose shards rerank the whole share.
AT_ONCE, NEAR_CELLS = 128, 8


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids of at most k clusters; empty clusters restart at points."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(points)))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        sizes = np.bincount(own, minlength=k)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], points[rng.choice(len(points), k)])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point."""
    out = np.empty(len(points), np.int64)
    norms = (centres**2).sum(axis=1)
    for a in range(0, len(points), 8192):
        out[a : a + 8192] = (norms - 2 * points[a : a + 8192] @ centres.T).argmin(axis=1)
    return out


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        dims = sample.shape[1]
        self.centres = kmeans(sample, max(1, min(cells, len(sample) // 16)))
        residuals = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = list(range(0, dims, DIMS_A_CODE)) + [dims]
        self.books = [kmeans(residuals[:, a:b], CODES, 8) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, term): term is the part of the squared distance that depends on the vector alone."""
        cell = nearest(vectors, self.centres)
        base = self.centres[cell]
        residuals = vectors - base
        codes = np.empty((len(vectors), len(self.books)), np.uint8)
        term = np.zeros(len(vectors))
        for m, book in enumerate(self.books):
            a, b = self.cuts[m], self.cuts[m + 1]
            codes[:, m] = nearest(residuals[:, a:b], book)
            near = book[codes[:, m]]
            term += (near**2).sum(axis=1) + 2 * (base[:, a:b] * near).sum(axis=1)
        return cell, codes, term

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the centroids, and products with every codeword."""
        coarse = ((queries[:, None, :] - self.centres[None]) ** 2).sum(axis=2)
        products = np.zeros((len(queries), len(self.books), CODES), np.float32)
        for m, book in enumerate(self.books):
            products[:, m, : len(book)] = queries[:, self.cuts[m] : self.cuts[m + 1]] @ book.T
        return coarse, products

    def distances(self, coarse: np.ndarray, products: np.ndarray, cell: np.ndarray, codes: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of every query to every vector."""
        sums = np.zeros((len(coarse), len(cell)), np.float32)
        for m in range(codes.shape[1]):
            sums += products[:, m][:, codes[:, m]]
        return coarse.astype(np.float32)[:, cell] + term.astype(np.float32) - 2 * sums

    def choose(self, sample: np.ndarray, asked: np.ndarray, k: int, recall: float) -> None:
        """Sets ``probes`` (cells of a query) and ``share`` (of their vectors, to rerank) by brute force on ``sample``."""
        self.probes, self.share = len(self.centres), 1.0
        if len(sample) <= k or not len(asked):
            return
        cell, codes, term = self.encode(sample)
        coarse, products = self.tables(asked)
        exact = (sample**2).sum(axis=1) - 2 * asked @ sample.T
        true = np.argpartition(exact, k, axis=1)[:, :k]
        place = np.argsort(np.argsort(coarse, axis=1, kind="stable"), axis=1)
        part = (1 + recall) / 2
        self.probes = int(np.quantile(np.take_along_axis(place, cell[true], axis=1) + 1, part, method="higher"))
        near = self.distances(coarse, products, cell, codes, term)
        near[np.take_along_axis(place, np.broadcast_to(cell, near.shape), axis=1) >= self.probes] = np.inf
        ahead = np.stack([np.searchsorted(np.sort(row), row[own], side="right") for row, own in zip(near, true, strict=True)])
        self.share = float(np.quantile(ahead / np.maximum(np.isfinite(near).sum(axis=1, keepdims=True), 1), part, method="higher"))

    def probed(self, coarse: np.ndarray) -> np.ndarray:
        """The cells that each query is compared with, nearest first."""
        return np.argsort(coarse, axis=1, kind="stable")[:, : self.probes]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(``vec_id``, ``vector`` array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (common.n if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def indexed(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` with ``cell``, ``codes`` and ``term``, in the order of cells within each part."""
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes, term = sent.value.encode(matrix(batch.column("vector")))
                arrays = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(term)]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "vector", "cell", "codes", "term"])

    return rows.mapInArrow(of, "vec_id long, vector array<double>, cell int, codes binary, term double")


def best(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest, ties by id."""
    if len(distances) > k:
        limit = np.partition(distances, k - 1)[k - 1]
        some = np.flatnonzero(distances <= limit)
    else:
        some = np.flatnonzero(distances < np.inf)
    some = some[distances[some] < np.inf]
    return some[np.lexsort((ids[some], distances[some]))[:k]]


class Shards:
    """Which shards hold a cell: ``first`` and ``parts`` of them; near cells lie side by side."""

    def __init__(self, index: Index, sizes: np.ndarray, most: int) -> None:
        centred = index.centres - index.centres.mean(axis=0)
        axis = np.linalg.svd(centred, full_matrices=False)[2][0]
        self.sizes = sizes
        self.first, self.parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        shard, held = 0, 0
        for cell in np.argsort(centred @ axis, kind="stable").tolist():
            size = int(sizes[cell])
            if held and held + size > most:
                shard, held = shard + 1, 0
            self.first[cell] = shard
            if size > most:
                self.parts[cell] = -(-size // most)
                shard += int(self.parts[cell])
            else:
                held += size

    def of(self, cells: np.ndarray) -> list[int]:
        """All shards of some cells."""
        return np.unique(np.concatenate([np.arange(self.first[c], self.first[c] + self.parts[c]) for c in cells.tolist()])).tolist()


def sent_to(asked: DataFrame, index: Index, shards: Shards) -> DataFrame:
    """``asked`` (``vec_id``, ``vector``) with ``shards``, the list of the shards of each query's cells."""
    sent = asked.sparkSession.sparkContext.broadcast((index, shards))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, where = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                cells = own.probed(own.tables(matrix(part.column("vector")))[0])
                lists = pa.array([where.of(row) for row in cells], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["vec_id", "vector", "shards"])

    return asked.mapInArrow(of, "vec_id long, vector array<double>, shards array<long>")


class Held:
    """The vectors of one shard, as the queries that pass by need them."""

    def __init__(self, vectors: pa.Table) -> None:
        self.ids, self.cell = vectors.column("vec_id").to_numpy(), vectors.column("cell").to_numpy()
        self.exact = matrix(vectors.column("vector").combine_chunks())
        self.codes = np.frombuffer(b"".join(vectors.column("codes").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.term = vectors.column("term").to_numpy()
        self.present = np.unique(self.cell)

    def nearest(self, index: Index, shards: Shards, k: int, names: np.ndarray, queries: np.ndarray) -> pa.RecordBatch:
        """The k nearest of each query among the vectors in its cells."""
        out: tuple[list[np.ndarray], ...] = ([], [], [])
        coarse, products = index.tables(queries)
        cells = index.probed(coarse)
        wanted = np.zeros(coarse.shape, bool)
        np.put_along_axis(wanted, cells, True, axis=1)
        near = index.distances(coarse, products, self.cell, self.codes, self.term)
        near[~wanted[:, self.cell]] = np.inf
        for q, row in enumerate(near):
            row[self.ids == names[q]] = np.inf
            # A shard reranks its share of its own candidates; one with the query's nearest cells that of all.
            here = np.isfinite(row).sum()
            close = np.isin(cells[q, :NEAR_CELLS], self.present).any()
            limit = max(4 * k, math.ceil(index.share * (shards.sizes[cells[q]].sum() if close else 2 * here)))
            chosen = best(row, self.ids, limit)
            distance = np.sqrt(((self.exact[chosen] - queries[q]) ** 2).sum(axis=1))
            top = np.lexsort((self.ids[chosen], distance))[:k]
            for column, values in zip(out, (np.full(len(top), names[q]), self.ids[chosen][top], distance[top]), strict=True):
                column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])


def stream_past(index: Index, shards: Shards, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k nearest within each shard, from rows sorted by ``shard`` and ``block`` with vectors ahead of queries."""
    at, vectors, held = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(name).to_numpy() for name in ("shard", "block", "asks")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            part, (shard, block, asks) = batch.slice(a, b - a), keys[:, a].tolist()
            if at != (shard, block):
                at, vectors, held = (shard, block), [], None
            if not asks:
                vectors.append(part)
                continue
            if held is None and vectors:
                held, vectors = Held(pa.Table.from_batches(vectors)), []
            for c in range(0, part.num_rows if held else 0, AT_ONCE):
                some = part.slice(c, AT_ONCE)
                yield held.nearest(index, shards, k, some.column("vec_id").to_numpy(), matrix(some.column("vector")))


def search(vectors: DataFrame, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, recall: float = RECALL, cells: int | None = None, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """The k nearest of every row that the SQL condition ``is_query`` (on ``vec_id``) names: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    n = rows.count()
    sample = rows if n <= SAMPLE else rows.where(F.rand(7) < 0.95 * SAMPLE / n)
    sample = sample.select("vector").toArrow().column("vector").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = matrix(sample)[np.random.default_rng(1).permutation(len(sample))]
    held = min(HELD, len(sample) // 5)
    index = Index(sample[held:], cells or math.isqrt(n))
    index.choose(sample[held:], sample[:held], k, recall)
    stored = write_stage(indexed(rows, index), "ann")
    counted = stored.groupBy("cell").count().collect()
    sizes = np.zeros(len(index.centres), np.int64)
    sizes[[r["cell"] for r in counted]] = [r["count"] for r in counted]
    most = min(shard, SHARD_BYTES // (8 * sample.shape[1]) + 1, max(LEAST, n // SHARDS))
    shards = Shards(index, sizes, most)
    places = spark.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(shards.first, shards.parts, strict=True))], "cell int, first long, parts long")
    placed = stored.join(F.broadcast(places), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("first", "parts")
    asked = write_stage(sent_to(stored.where(is_query).select("vec_id", "vector").distinct(), index, shards), "asked")
    asked = asked.withColumn("shard", F.explode("shards")).drop("shards")
    # One row for each shard that is asked: fewer than vectors by thousands.
    blocks = write_stage(asked.groupBy("shard").agg(F.ceil(F.count("*") / queries).alias("blocks")), "blocks")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = placed.join(blocks, "shard").withColumn("block", block).withColumn("asks", F.lit(0)).drop("blocks")
    right = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).withColumn("asks", F.lit(1)).drop("blocks")
    sent = spark.sparkContext.broadcast((index, shards))
    rows = left.unionByName(right, allowMissingColumns=True).repartition("shard", "block").sortWithinPartitions("shard", "block", "asks")
    found = rows.mapInArrow(lambda batches: stream_past(*sent.value, k, batches), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract query of operator 8."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0")
