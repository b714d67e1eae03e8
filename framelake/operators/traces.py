"""Operators on traces (``roi_id``, ``frame``, ``f``): windows, percentiles, frame filters, dF/F.

All are native but the running percentile, whose windows slide in Arrow tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from framelake.functions.compat import gaussian_weights, group_percentile

#: Frames of a trace that a task takes at a time.
BLOCK = 4096


def series() -> WindowSpec:
    """The frames of each trace in order."""
    return Window.partitionBy("roi_id").orderBy("frame")


def difference(trace: DataFrame) -> DataFrame:
    """First difference ``d``; null on the first frame."""
    return trace.withColumn("d", F.col("f") - F.lag("f").over(series()))


def gaussian_smooth(trace: DataFrame, length: int, edges: str = "same") -> DataFrame:
    """Gaussian window; ``same`` pads with zeros, ``valid`` drops the frames whose window is cut."""
    half = length // 2
    total = F.lit(0.0)
    for k, weight in enumerate(gaussian_weights(length)):
        shift = k - half
        total = total + F.lit(weight) * F.coalesce((F.lag("f", -shift) if shift < 0 else F.lead("f", shift)).over(series()) if shift else F.col("f"), F.lit(0.0))
    out = trace.withColumn("smooth", total)
    if edges == "same":
        return out
    last = F.max("frame").over(Window.partitionBy("roi_id"))
    return out.withColumn("last", last).where((F.col("frame") >= half) & (F.col("frame") <= F.col("last") - (length - 1 - half))).drop("last")


def sliding_order(values: np.ndarray, starts: np.ndarray, length: int, nth: int) -> np.ndarray:
    """The value of rank ``nth`` in each window ``values[start : start + length]``; ``starts`` never go back.

    The windows slide over the values' ranks, kept as a sorted list: a step removes what left and adds what came by binary
    search.  What is not a number ranks last.
    """
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    ranks, found = rank.tolist(), np.empty(len(starts), np.int64)
    held: list[int] = []
    low = high = 0
    for k, start in enumerate(starts.tolist()):
        if start >= high:
            held, low, high = sorted(ranks[start : start + length]), start, start + length
        while low < start:
            del held[bisect_left(held, ranks[low])]
            low += 1
        while high < start + length:
            insort(held, ranks[high])
            high += 1
        found[k] = held[nth]
    return values[order[found]]


def running_percentile(trace: DataFrame, length: int, percent: float) -> DataFrame:
    """Order statistic of a centred window; the first and last frames take the nearest full window's value."""
    half, nth = length // 2, min(math.ceil(length * percent / 100), length - 1)
    n = F.count("*").over(Window.partitionBy("roi_id"))
    rows = trace.select("roi_id", "frame", F.col("f").cast("double").alias("f"), (F.row_number().over(series()) - 1).cast("long").alias("k"), n.alias("n")).where(F.col("n") > 2 * length)
    # A block of a trace gets the frames of its windows as well, so that a task never holds more than a block.
    own, last = F.expr(f"k div {BLOCK}"), F.expr(f"(n - 1) div {BLOCK}")
    first_centre, last_centre = F.greatest(F.col("k") - (length - 1 - half), F.lit(length)), F.least(F.col("k") + half, F.col("n") - length - 1)
    low = F.when(first_centre <= length, F.lit(0)).otherwise(F.floor(first_centre / BLOCK)).cast("long")
    high = F.when(last_centre >= F.col("n") - length - 1, last).otherwise(F.floor(last_centre / BLOCK)).cast("long")
    blocks = F.sequence(F.least(low, own), F.greatest(high, own))
    dealt = rows.withColumn("block", F.explode(blocks)).repartition("roi_id", "block").sortWithinPartitions("roi_id", "block", "k")
    kinds = dict(trace.dtypes)

    def found(k: np.ndarray, n: int, block: int, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(k // BLOCK == block)
        starts = np.searchsorted(k, np.clip(k[own], length, n - length - 1) - half)
        return own, sliding_order(f, starts, length, nth)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            out, held = whole_blocks(held, False)
            if out is not None:
                yield from out
        if held is not None and held.num_rows:
            yield from whole_blocks(held, True)[0]

    def whole_blocks(rows: pa.Table, ended: bool) -> tuple[list[pa.RecordBatch] | None, pa.Table]:
        """What the blocks that are complete give, and the rows of the last one, which may go on."""
        k, n, block = (rows.column(c).to_numpy() for c in ("k", "n", "block"))
        # Within a block k counts up; at the next one, of this trace or another, the block or k goes back or the block changes.
        cuts = np.flatnonzero((np.diff(k) <= 0) | (np.diff(block) != 0)) + 1
        if not ended and not len(cuts):
            return None, rows
        edges = [0, *cuts.tolist(), *([len(k)] if ended else [])]
        f = rows.column("f").to_numpy()  # missing ones are not a number
        parts = [(a, *found(k[a:b], int(n[a]), int(block[a]), f[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        where = pa.array(np.concatenate([a + own for a, own, _ in parts]))
        running = pa.array(np.concatenate([v for _, _, v in parts]), from_pandas=True)
        out = rows.select(["roi_id", "frame"]).take(where).append_column("running", running).combine_chunks()
        return out.to_batches(), rows.slice(edges[-1])

    return dealt.mapInArrow(of, f"roi_id {kinds['roi_id']}, frame {kinds['frame']}, running double")


def running_max(trace: DataFrame, length: int) -> DataFrame:
    """Largest value of a centred window, cut at the ends."""
    return trace.withColumn("running", F.max("f").over(series().rowsBetween(-(length // 2), length - 1 - length // 2)))


def block_percentile(trace: DataFrame, length: int, percent: float, padded: bool = False) -> DataFrame:
    """Percentile of each block of frames, over the frames there are; ``padded`` fills a trace's last block up with zeros."""
    if padded:
        ends = trace.groupBy("roi_id").agg((F.max("frame") + 1).alias("n")).where(F.col("n") % length > 0)
        rest = ends.select("roi_id", F.explode(F.expr(f"sequence(n, (n div {length} + 1) * {length} - 1)")).alias("frame"), F.lit(0.0).alias("f"))
        trace = trace.select("roi_id", "frame", "f").unionByName(rest.withColumn("frame", F.col("frame").cast(trace.schema["frame"].dataType)))
    keyed = trace.withColumn("block", F.expr(f"frame div {length}"))
    return group_percentile(keyed, ["roi_id", "block"], "f", percent, "threshold")


def stable_frames(trace: DataFrame, span: int) -> DataFrame:
    """Frames whose smoothed absolute difference is at most its commonest value (in hundredths, least on ties)."""
    steps = difference(trace).withColumn("d", F.abs("d"))
    smooth = steps.withColumn("d", F.avg("d").over(series().rowsBetween(-(span // 2), span // 2)))
    mode = smooth.groupBy("roi_id").agg(F.mode(F.round(F.col("d") * 100).cast("long"), True).alias("mode"))
    return smooth.join(mode, "roi_id").where(F.col("d") <= F.col("mode") / 100).select("roi_id", "frame")


def inliers(trace: DataFrame, factor: float = 2.0) -> DataFrame:
    """Frames below median + factor * mean absolute deviation of their trace."""
    centre = trace.groupBy("roi_id").agg(F.avg("f").alias("m"), F.median("f").alias("mid"))
    spread = trace.join(centre, "roi_id").groupBy("roi_id").agg(F.first("mid").alias("mid"), F.avg(F.abs(F.col("f") - F.col("m"))).alias("mad"))
    return trace.join(spread, "roi_id").where(F.col("f") < F.col("mid") + factor * F.col("mad")).select("roi_id", "frame", "f")


def exclude_frames(trace: DataFrame, excluded: DataFrame) -> DataFrame:
    """Frames that are not excluded (``roi_id``, ``frame``), renumbered in ``kept_frame``."""
    return trace.join(excluded, ["roi_id", "frame"], "left_anti").withColumn("kept_frame", F.row_number().over(series()) - 1)


def reinsert_frames(values: DataFrame, full: DataFrame) -> DataFrame:
    """All frames again, null where they were excluded."""
    return full.select("roi_id", "frame").join(values, ["roi_id", "frame"], "left")


def delta_f(trace: DataFrame, percent: float = 10.0) -> DataFrame:
    """(f - F0) / F0 with F0 a low percentile of the trace."""
    base = group_percentile(trace, ["roi_id"], "f", percent, "f0")
    return trace.join(base, "roi_id").withColumn("df", F.try_divide(F.col("f") - F.col("f0"), F.col("f0")))


def fill_gaps(trace: DataFrame) -> DataFrame:
    """Missing values by linear interpolation; ahead of the first value one less than it, after the last one more."""
    before, after = series().rowsBetween(Window.unboundedPreceding, 0), series().rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("f").isNotNull(), F.struct("frame", "f"))
    both = trace.withColumn("a", F.last(at, True).over(before)).withColumn("b", F.first(at, True).over(after))
    share = F.try_divide(F.col("frame") - F.col("a.frame"), F.col("b.frame") - F.col("a.frame"))
    between = F.col("a.f") + F.coalesce(share, F.lit(0.0)) * (F.col("b.f") - F.col("a.f"))
    return both.withColumn("filled", F.when(F.col("a").isNull(), F.col("b.f") - 1).when(F.col("b").isNull(), F.col("a.f") + 1).otherwise(between)).drop("a", "b")
