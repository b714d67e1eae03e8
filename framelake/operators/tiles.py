"""Pixel covariance of wide bands by image tiles.

``movie.pixel_covariance`` sends every bin once for each offset of the band, which suits a few dozen offsets.  A band of
radius 11 has 1013 of them; here a pixel's series goes only to the tiles whose own pixels or halo hold it, about four
times at the default side, and a tile's covariances are one matrix product for each movie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled_series(bins: DataFrame, neighbourhood: int, height: int, width: int, side: int, splits: int) -> DataFrame:
    """(``tile``, ``part``, ``movie``, ``px``, ``bins``, ``series``): each pixel's bins and their values, for every tile
    that needs them."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("bin").cast("long").alias("bin"), F.col("v").cast("double").alias("v"))))
    series = bins.where("v IS NOT NULL AND NOT isnan(v)").groupBy("movie", "px").agg(ordered.alias("s"))
    series = series.select("movie", "px", F.col("s.bin").alias("bins"), F.col("s.v").alias("series"))
    row, col, halo, down = F.col("px") % height, F.floor(F.col("px") / height), neighbourhood - 1, -(-height // side)
    # Own pixels reach rows on both sides and columns to the right.
    last = F.least(F.floor((row + halo) / side), F.lit(down - 1))
    rows = F.explode(F.sequence(F.floor(F.greatest(row - halo, F.lit(0)) / side), last)).alias("tr")
    placed = series.select("movie", "px", "bins", "series", rows)
    cols = F.explode(F.sequence(F.floor(F.greatest(col - halo, F.lit(0)) / side), F.floor(col / side))).alias("tc")
    placed = placed.select("movie", "px", "bins", "series", "tr", cols)
    return placed.select((F.col("tr") + F.col("tc") * down).cast("int").alias("tile"), F.pmod(F.xxhash64("movie"), F.lit(splits)).cast("int").alias("part"), "movie", "px", "bins", "series")


def pixel_covariance(bins: DataFrame, neighbourhood: int, height: int, width: int, side: int = 32, splits: int = 16) -> DataFrame:
    """The same rows as ``movie.pixel_covariance``: (``px_i``, ``px_j``, ``cov``) of neighbours i <= j.

    Values are placed by their bins, so that a pair's covariance is over the bins that both have; pixels may lack any.
    Movies of a tile are dealt to ``splits`` parts and added up one at a time, so a task holds one movie of one tile and
    a few matrices of own by halo pixels (35 MB each at side 32 and neighbourhood 23), whatever the number of movies.  A
    pair without a common bin in a movie has no part in that movie's average.  No bins give no rows.
    """
    down = -(-height // side)

    def places(tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top, left = tile % down * side, tile // down * side
        r, c = np.arange(top, min(top + side, height)), np.arange(left, min(left + side, width))
        own = (r[None] + c[:, None] * height).ravel()
        r = np.arange(max(top - neighbourhood + 1, 0), min(top + side + neighbourhood - 1, height))
        c = np.arange(left, min(left + side + neighbourhood - 1, width))
        around = (r[None] + c[:, None] * height).ravel()
        d_row, d_col = around[None] % height - own[:, None] % height, around[None] // height - own[:, None] // height
        band = (np.abs(d_row) < neighbourhood) & (d_col >= 0) & (d_col < neighbourhood) & ((d_col > 0) | (d_row >= 0))
        return own, around, band

    class Sums:
        """Running sums of one tile."""

        def __init__(self, tile: int):
            self.own, self.around, self.band = places(tile)
            self.total, self.count = np.zeros(self.band.shape), np.zeros(self.band.shape, np.int32)

        def add(self, px: np.ndarray, bins: list[np.ndarray], values: list[np.ndarray]) -> None:
            every, column = np.unique(np.concatenate(bins), return_inverse=True)
            row = np.repeat(np.searchsorted(self.around, px), [len(b) for b in bins])
            data, there = np.zeros((len(self.around), len(every))), np.zeros((len(self.around), len(every)))
            data[row, column] = np.concatenate([v - v.mean() for v in values])
            there[row, column] = 1
            mine = np.searchsorted(self.around, self.own)
            shared = there[mine] @ there.T
            some = np.maximum(shared, 1)
            # Means are over the common bins: nought for pixels that have all of each other's.
            cov = data[mine] @ data.T / some - (data[mine] @ there.T / some) * (there[mine] @ data.T / some)
            self.total += np.where(shared > 0, cov, 0)
            self.count += shared > 0

        def rows(self) -> pa.RecordBatch:
            i, j = np.nonzero(self.band & (self.count > 0))
            return pa.RecordBatch.from_arrays([pa.array(self.own[i].astype(np.int32)), pa.array(self.around[j].astype(np.int32)), pa.array(self.total[i, j]), pa.array(self.count[i, j].astype(np.int64))], ["px_i", "px_j", "s", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, sums, px, bins_, series = None, None, None, [], [], []
        for batch in batches:
            lists, numbers = batch.column("series"), batch.column("bins")
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "part", "movie", "px")), strict=True)):
                if row[:3] != group:
                    if px:
                        sums.add(np.array(px), bins_, series)
                    px, bins_, series = [], [], []
                    if row[:2] != key:
                        if sums is not None:
                            yield sums.rows()
                        key, sums = row[:2], Sums(row[0])
                    group = row[:3]
                px.append(row[3])
                bins_.append(numbers[k].values.to_numpy(zero_copy_only=False))
                series.append(lists[k].values.to_numpy(zero_copy_only=False))
        if px:
            sums.add(np.array(px), bins_, series)
            yield sums.rows()

    dealt = tiled_series(bins, neighbourhood, height, width, side, splits).repartition("tile", "part").sortWithinPartitions("tile", "part", "movie", "px")
    parts = dealt.mapInArrow(of, "px_i int, px_j int, s double, n long")
    return parts.groupBy("px_i", "px_j").agg((F.sum("s") / F.sum("n")).alias("cov"))
