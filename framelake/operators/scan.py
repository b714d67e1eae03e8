"""Motion faster than a frame, from a scan's own timing: every pixel is read at its own time and has its own displacement.

Displacements are knots at equal times over a frame, a knot every few lines, linear in time between them (after the model of
Greenberg and Kerr 2009).  A frame's knots are found by Gauss-Newton steps on the reference: a step that does not raise the
correlation is halved, and each frame starts from the last accepted one of its movie.  Correction scatters the frame's
pixels onto the places where they were recorded, a value shared by its four neighbours by bilinear weights, and divides by
the weights; places that nothing reached are filled from the nearest that something did.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import registration as R


class Timing:
    """When the pixels of a frame are read: the knot interval of each and how far within it."""

    def __init__(self, height: int, width: int, lines: int = 2, both_ways: bool = False) -> None:
        col = np.tile(np.arange(width), (height, 1))
        if both_ways:
            col[1::2] = col[1::2, ::-1]
        self.intervals = max(height // lines, 1)
        at = (np.arange(height)[:, None] * width + col + 0.5) / (height * width) * self.intervals
        self.before = np.minimum(at.astype(int), self.intervals - 1)
        self.part = at - self.before
        self.knots = self.intervals + 1

    def spread(self, knots: np.ndarray) -> np.ndarray:
        """The displacement of every pixel."""
        return knots[self.before] * (1 - self.part) + knots[self.before + 1] * self.part

    def gather(self, values: np.ndarray) -> np.ndarray:
        """The sum for each knot of the pixels' values by their weights: the transpose of ``spread``."""
        low = np.bincount(self.before.ravel(), (values * (1 - self.part)).ravel(), self.knots)
        return low + np.bincount(self.before.ravel() + 1, (values * self.part).ravel(), self.knots)

    def normal(self, weights: np.ndarray) -> np.ndarray:
        """The matrix of products of the knots' weights, summed with the pixels' ``weights``; only neighbours have any."""
        out = np.zeros((self.knots, self.knots))
        k, p = self.before.ravel(), self.part.ravel()
        w = weights.ravel()
        n = np.arange(self.knots)
        out[n, n] = np.bincount(k, w * (1 - p) ** 2, self.knots) + np.bincount(k + 1, w * p**2, self.knots)
        beside = np.bincount(k, w * p * (1 - p), self.knots)[:-1]
        out[n[:-1], n[1:]] = out[n[1:], n[:-1]] = beside
        return out


def scan_motion(reference: np.ndarray, frame: np.ndarray, timing: Timing, start: np.ndarray | None = None, halt: float = 0.995, rounds: int = 120, still: float = 0.01) -> tuple[np.ndarray, float]:
    """(knots as rows and columns, correlation): pixel (y, x) of the frame was recorded at (y + dy, x + dx) of the reference.

    Ends when the correlation reaches ``halt``, a step moves no knot by ``still`` pixels, or no part of a step helps.
    """
    rows, cols = np.mgrid[: frame.shape[0], : frame.shape[1]].astype(float)
    slopes = np.gradient(reference)
    if start is None:
        shift = R.subpixel_shift(reference, frame, 10)
        start = np.repeat(np.array(shift)[:, None], timing.knots, axis=1)

    def look(p: np.ndarray) -> tuple[float, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        places = rows + timing.spread(p[0]), cols + timing.spread(p[1])
        seen = R.sample(reference, *places)
        ok = np.isfinite(seen)
        if ok.sum() < 16 or np.ptp(seen[ok]) == 0 or np.ptp(frame[ok]) == 0:
            return -1.0, seen, places
        return float(np.corrcoef(seen[ok], frame[ok])[0, 1]), seen, places

    p = start
    r, seen, places = look(p)
    for _ in range(rounds):
        if r >= halt:
            break
        ok = np.isfinite(seen)
        off = np.where(ok, frame - seen, 0.0)
        gy, gx = (np.where(ok, np.nan_to_num(R.sample(s, *places)), 0.0) for s in slopes)
        top, cross, low = timing.normal(gy * gy), timing.normal(gy * gx), timing.normal(gx * gx)
        square = np.block([[top, cross], [cross, low]])
        # Neighbouring knots are held together a little, or lines without structure would drift.
        stiff = 2 * np.eye(timing.knots) - np.eye(timing.knots, k=1) - np.eye(timing.knots, k=-1)
        stiff[0, 0] = stiff[-1, -1] = 1
        ridge = 1e-2 * np.trace(square) / len(square)
        square = square + ridge * np.kron(np.eye(2), stiff) + 1e-9 * (1 + ridge) * np.eye(len(square))
        pull = np.concatenate((timing.gather(gy * off), timing.gather(gx * off)))
        pull = pull - ridge * np.concatenate((stiff @ p[0], stiff @ p[1]))
        step = np.linalg.solve(square, pull).reshape(2, -1)
        for k in range(7):
            tried = look(p + step / 2**k)
            if tried[0] > r:
                p, (r, seen, places) = p + step / 2**k, tried
                break
        else:
            break
        if np.abs(step).max() / 2**k < still:
            break
    return p, r


def splat(values: np.ndarray, rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(weighted sums, weights) of values scattered to real places of an image; what falls outside it is lost."""
    ok = (rows >= 0) & (cols >= 0) & (rows <= shape[0] - 1) & (cols <= shape[1] - 1) & np.isfinite(values)
    v, r, c = values[ok], rows[ok], cols[ok]
    r0, c0 = np.minimum(r.astype(int), max(shape[0] - 2, 0)), np.minimum(c.astype(int), max(shape[1] - 2, 0))
    y, x = r - r0, c - c0
    total, weight = np.zeros(shape[0] * shape[1]), np.zeros(shape[0] * shape[1])
    for i, j, w in ((0, 0, (1 - y) * (1 - x)), (0, 1, (1 - y) * x), (1, 0, y * (1 - x)), (1, 1, y * x)):
        at = np.minimum(r0 + i, shape[0] - 1) * shape[1] + np.minimum(c0 + j, shape[1] - 1)
        total += np.bincount(at, w * v, len(total))
        weight += np.bincount(at, w, len(weight))
    return total.reshape(shape), weight.reshape(shape)


def fill_holes(total: np.ndarray, weight: np.ndarray, reach: int | None = None) -> np.ndarray:
    """The image of weighted sums over weights; a hole takes the mean of its neighbours, ring after ring from the edge of what
    is known, up to ``reach`` rings (None: all).  Holes that are left are not numbers."""
    known = weight > 1e-6
    out = np.divide(total, weight, out=np.full(total.shape, np.nan), where=known)
    ring = 0
    while not known.all() and known.any() and (reach is None or ring < reach):
        padded, there = np.pad(np.where(known, out, 0.0), 1), np.pad(known, 1).astype(float)
        near, count = np.zeros(out.shape), np.zeros(out.shape)
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                near += padded[dy : dy + out.shape[0], dx : dx + out.shape[1]]
                count += there[dy : dy + out.shape[0], dx : dx + out.shape[1]]
        new = ~known & (count > 0)
        out[new] = near[new] / count[new]
        known = known | new
        ring += 1
    return out


def corrected(frame: np.ndarray, knots: np.ndarray, timing: Timing, reach: int | None = None) -> np.ndarray:
    """The frame with its pixels where they were recorded."""
    rows, cols = np.mgrid[: frame.shape[0], : frame.shape[1]].astype(float)
    return fill_holes(*splat(frame, rows + timing.spread(knots[0]), cols + timing.spread(knots[1]), frame.shape), reach)


def scan_motions(frames: DataFrame, references: DataFrame, height: int, width: int, lines: int = 2, both_ways: bool = False, accept: float = 0.75, halt: float = 0.995, rounds: int = 120) -> DataFrame:
    """(``movie``, ``frame``, ``dy``, ``dx``, ``r``, ``ok``): the knots of every frame on its movie's reference, which is of the
    square root of intensities; ``ok`` where the correlation reached ``accept``.  Frames of a movie come in order, a
    batch at a time, and between frames only the last accepted knots are kept."""
    timing = Timing(height, width, lines, both_ways)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            found = []
            for movie, values, reference in zip(*(R.views(batch.column(c)) for c in ("movie", "values", "reference")), strict=True):
                held = held if movie == last else None
                frame = np.sqrt(np.maximum(np.nan_to_num(R.image(values, height)), 0))
                knots, r = scan_motion(R.image(reference, height), frame, timing, held, halt, rounds)
                held, last = (knots if r >= accept else held), movie
                found.append((knots[0], knots[1], r, bool(r >= accept)))
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("movie"), batch.column("frame"), *map(R.column_of, zip(*found, strict=True))], ["movie", "frame", "dy", "dx", "r", "ok"])

    kinds = dict(frames.dtypes)
    ordered = frames.select("movie", "frame", "values").join(references, "movie").repartition("movie").sortWithinPartitions("movie", "frame")
    return ordered.mapInArrow(of, f"movie {kinds['movie']}, frame {kinds['frame']}, dy array<double>, dx array<double>, r double, ok boolean")


def apply_scan_motions(frames: DataFrame, motions: DataFrame, height: int, width: int, lines: int = 2, both_ways: bool = False, reach: int | None = None) -> DataFrame:
    """Frames with every pixel scattered to where it was recorded; those whose motion was not accepted stay as they are."""
    timing = Timing(height, width, lines, both_ways)

    def kernel(values, dy, dx, ok):
        frame = R.image(values, height)
        return (R.column_major(corrected(frame, np.array([dy, dx]), timing, reach) if ok else frame),)

    rows = frames.select("movie", "frame", "values").join(motions.select("movie", "frame", "dy", "dx", "ok"), ["movie", "frame"])
    return R.per_frame(rows, kernel, ["values", "dy", "dx", "ok"], "values array<double>")
