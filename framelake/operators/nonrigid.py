"""Registration of whole movies onto a reference movie: affine, demons, and the strategies that chain all steps.

Frames get a whole-frame shift and line displacements on their own movie's image.  Each movie's corrected mean image is
then registered once, affinely and (by choice) by demons, onto the reference movie's; a movie has one row of numbers
for that, and a frame is resampled once, through the composed displacements.  Frames are shuffled by movie only where a
movie's row joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.sources.stages import kept

from . import images as I
from . import registration as R


def affine_displacement(matrix: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Displacements (rows, columns) of a 2 x 3 matrix, or of each of several, that acts on places counted from the image
    centre."""
    y, x = np.mgrid[:height, :width].astype(float)
    y, x = y - (height - 1) / 2, x - (width - 1) / 2
    m = matrix[..., None, None]
    return m[..., 0, 0, :, :] * y + m[..., 0, 1, :, :] * x + m[..., 0, 2, :, :] - y, m[..., 1, 0, :, :] * y + m[..., 1, 1, :, :] * x + m[..., 1, 2, :, :] - x


def mutual_information(a: np.ndarray, b: np.ndarray, bins: int = 32) -> np.ndarray:
    """Mutual information of each image of a stack with the other stack's where both have values; every pixel is spread
    linearly over two bins."""
    ok = np.isfinite(a) & np.isfinite(b)
    enough = ok.sum(axis=(1, 2)) >= 16
    low, part = [], []
    for v in (a, b):
        least, most = (f(np.where(ok, v, end), axis=(1, 2))[:, None, None] for f, end in ((np.min, np.inf), (np.max, -np.inf)))
        wide = np.where(enough[:, None, None], most - least, 0.0)
        place = np.zeros(v.shape)
        np.divide(v - least, wide, out=place, where=ok & (wide > 0))
        place = place * (bins - 1)
        low.append(np.minimum(place.astype(int), bins - 2))
        part.append(place - low[-1])
    own = np.arange(len(a))[:, None, None] * bins
    joint = np.zeros(len(a) * bins * bins)
    for i in (0, 1):
        for j in (0, 1):
            weight = (part[0] if i else 1 - part[0]) * (part[1] if j else 1 - part[1]) * ok
            joint += np.bincount(((own + low[0] + i) * bins + low[1] + j).ravel(), weight.ravel(), len(joint))
    joint = joint.reshape(len(a), -1)
    p = (joint / np.where(enough, joint.sum(axis=1), 1.0)[:, None]).reshape(len(a), bins, bins)
    apart = p.sum(axis=2, keepdims=True) * p.sum(axis=1, keepdims=True)
    some = p > 0
    terms = p[some] * np.log(p[some] / apart[some])
    return np.where(enough, [t.sum() for t in np.split(terms, np.cumsum(some.sum(axis=(1, 2)))[:-1])], -np.inf)


def affine_register(reference: np.ndarray, picture: np.ndarray, rounds: int = 300, seed: int = 0) -> np.ndarray:
    """The 2 x 3 matrix that reads ``picture`` into the place of ``reference``: starts at the whole-frame shift and climbs
    mutual information with a seeded (1+1) evolution strategy whose step grows on success and shrinks on failure."""
    return affine_registers(reference[None], picture[None], rounds, seed)[0]


def affine_registers(references: np.ndarray, pictures: np.ndarray, rounds: int = 300, seed: int = 0) -> np.ndarray:
    """``affine_register`` of every image of a stack; all draw the same steps, and one that has stopped leaves the rounds."""
    n, h, w = references.shape
    best = np.tile(np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]), (n, 1, 1))
    best[:, 0, 2], best[:, 1, 2] = (-s for s in R.subpixel_shifts(references, pictures, 10))
    scale = np.array([[2 / h, 2 / w, 1.0], [2 / h, 2 / w, 1.0]])

    def score(own: np.ndarray, matrices: np.ndarray) -> np.ndarray:
        return mutual_information(references[own], R.warp(pictures[own], *affine_displacement(matrices, h, w)))

    rng, step, left = np.random.default_rng(seed), np.ones(n), np.arange(n)
    top = score(left, best)
    for _ in range(rounds):
        tried = best[left] + step[left][:, None, None] * scale * rng.normal(size=(2, 3))
        found = score(left, tried)
        up = found > top[left]
        best[left[up]], top[left[up]] = tried[up], found[up]
        step[left] *= np.where(up, 1.5, 1.5**-0.25)
        left = left[step[left] >= 1e-4]
        if not len(left):
            break
    return best


def demons(reference: np.ndarray, picture: np.ndarray, smooth: float = 5.0, rounds: int = 60, margin: float = 0.05, levels: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Dense displacements that read ``picture`` into ``reference`` (Thirion 1998) on images over their local means.

    Earlier corrections leave a dark border on ``picture``; its outer ``margin`` is replaced by the strips just within, so that
    the border does not pull at the field.  The field starts on images halved ``levels`` - 1 times (as long as a side keeps 32
    pixels), and is smoothed in every round.  Of stacks too.
    """
    inner = I.interior_strips(np.nan_to_num(picture), round(margin * min(picture.shape[-2:])))  # before the local means, which spread it
    pyramid = [tuple(I.high_pass(np.maximum(np.nan_to_num(p), 0), max(p.shape[-2:]) / 8) for p in (reference, inner))]
    while len(pyramid) < levels and min(pyramid[-1][0].shape[-2:]) >= 64:
        pyramid.append(tuple(map(I.halved, pyramid[-1])))
    field: list[np.ndarray] | None = None
    for a, b in reversed(pyramid):
        rows, cols = np.mgrid[: a.shape[-2], : a.shape[-1]].astype(float)
        if field is None:
            field = [np.zeros(a.shape), np.zeros(a.shape)]
        else:
            coarse = field[0].shape[-2:]
            field = [2 * R.sample(f, np.minimum(rows / 2, coarse[0] - 1), np.minimum(cols / 2, coarse[1] - 1)) for f in field]
        slopes = np.gradient(a, axis=(-2, -1))
        steep = slopes[0] ** 2 + slopes[1] ** 2
        for _ in range(rounds):
            moved = R.warp(b, *field)
            off = np.where(np.isnan(moved), 0.0, a - moved)
            power = steep + off**2
            push = np.divide(off, power, out=np.zeros_like(off), where=power > 1e-12)
            field = [I.blur(f + push * s, smooth) for f, s in zip(field, slopes, strict=True)]
    return field[0], field[1]


def mean_images(frames: DataFrame) -> DataFrame:
    """Mean image of each movie as one array; places without any value are null."""
    px = frames.select("movie", F.posexplode("values").alias("px", "v"))
    means = px.groupBy("movie", "px").agg(R.steady(F.avg("v")).alias("m"))
    return means.groupBy("movie").agg(F.transform(F.sort_array(F.collect_list(F.struct("px", "m"))), lambda s: s["m"]).alias("image"))


def movie_fields(pictures: DataFrame, reference_movie: int, height: int, width: int, nonrigid: bool = True, smooth: float = 5.0, rounds: int = 300) -> DataFrame:
    """Per movie the displacements (``fy``, ``fx``, column-major) onto the reference movie's image: affine, then demons.

    A movie is a small row that costs much, and Spark merges partitions by their bytes, so the number of parts is given here;
    by the bare ``movie`` it would keep the parts of the mean images.
    """
    target = pictures.where(F.col("movie") == reference_movie).select(F.col("movie").alias("onto"), F.col("image").alias("target"))
    dealt = pictures.repartition(pictures.sparkSession.sparkContext.defaultParallelism, F.xxhash64("movie"))
    both = dealt.withColumn("onto", F.lit(reference_movie)).join(F.broadcast(target), "onto")  # one image

    def kernel(movie, picture, target):
        a, b = (np.nan_to_num(R.images(p, height)) for p in (target, picture))
        field = affine_displacement(affine_registers(a, b, rounds), height, width)
        if nonrigid:
            field = R.compose(field, demons(a, np.nan_to_num(R.warp(b, *field)), smooth))
        return tuple(np.where((movie == reference_movie)[:, None], 0.0, R.column_major(f)) for f in field)

    return R.per_stack(both, kernel, ["movie", "image", "target"], "fy array<double>, fx array<double>", ("movie",))


def apply_fields(frames: DataFrame, lines: DataFrame, fields: DataFrame, height: int, bicubic: bool = True) -> DataFrame:
    """Frames read once through their line displacements (``dy``, ``dx``) composed with their movie's field."""

    def kernel(values, dy, dx, fy, fx):
        picture, second = R.images(values, height), (R.images(fy, height), R.images(fx, height))
        rows, cols = np.mgrid[: picture.shape[1], : picture.shape[2]].astype(float)
        first = [np.broadcast_to(d[:, :, None], picture.shape) for d in (dy, dx)]
        moved = R.compose(first, second)
        read = I.cubic if bicubic else R.sample
        return (R.column_major(read(picture, rows + moved[0], cols + moved[1])),)

    rows = frames.join(lines.select("movie", "frame", "dy", "dx"), ["movie", "frame"]).join(fields, "movie")
    return R.per_stack(rows, kernel, ["values", "dy", "dx", "fy", "fx"], "values array<double>")


def scan_line_shifts(frames: DataFrame, references: DataFrame, height: int, accept: float = 0.75, halt: float = 0.995, rounds: int = 120) -> DataFrame:
    """Line displacements at two lines a parameter, each frame started from the last accepted one of its movie.

    Frames of a movie come in order, a batch at a time; only one displacement is kept between frames.  ``ok`` says whether
    the correlation reached ``accept``.
    """
    spans = max(height // 2, 1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            rows = []
            for movie, values, reference in zip(*(batch.column(c).to_pylist() for c in ("movie", "values", "reference")), strict=True):
                held = held if movie == last else None
                target, frame = R.image(reference, height), np.sqrt(np.maximum(R.image(values, height), 0))
                dy, dx, r, knots = scan_lines(target, frame, spans, held, halt, rounds)
                held, last = (knots if r >= accept else held), movie
                rows.append((dy.tolist(), dx.tolist(), r, bool(r >= accept)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("movie"), batch.column("frame"), *(pa.array(c) for c in zip(*rows, strict=True))], ["movie", "frame", "dy", "dx", "r", "ok"])

    kinds = dict(frames.dtypes)
    ordered = frames.select("movie", "frame", "values").join(references, "movie").repartition("movie").sortWithinPartitions("movie", "frame")
    return ordered.mapInArrow(of, f"movie {kinds['movie']}, frame {kinds['frame']}, dy array<double>, dx array<double>, r double, ok boolean")


def scan_lines(reference: np.ndarray, frame: np.ndarray, spans: int, start: np.ndarray | None, halt: float, rounds: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Gauss-Newton on line knots; a step that lowers the correlation is halved, up to six times, then the search ends."""
    basis = R.line_basis(reference.shape[0], spans)
    shift = R.subpixel_shift(reference, frame, 10)
    p = start if start is not None else np.array([np.full(spans + 1, -s) for s in shift])
    ridge = 1e-2 * max(np.var(reference), 1e-9) * np.eye(spans + 1)

    def look(q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        moved = R.warp(frame, (basis @ q[0])[:, None], (basis @ q[1])[:, None])
        ok = ~np.isnan(moved)
        filled = np.where(ok, moved, reference)
        flat = filled.std() == 0 or reference.std() == 0
        return 0.0 if flat else float(np.corrcoef(filled.ravel(), reference.ravel())[0, 1]), filled, ok

    r, filled, ok = look(p)
    for _ in range(rounds):
        if r >= halt:
            break
        slopes, off = np.gradient(filled), reference - filled
        step = np.array([np.linalg.solve((basis * ((s * ok) ** 2).sum(axis=1)[:, None]).T @ basis + ridge, basis.T @ (off * s * ok).sum(axis=1)) for s in slopes])
        for k in range(7):
            tried = look(p + step / 2**k)
            if tried[0] > r + 1e-6:
                p, (r, filled, ok) = p + step / 2**k, tried
                break
        else:
            break
    return basis @ p[0], basis @ p[1], r, p


def block_shifts(frames: DataFrame, references: DataFrame, height: int, blocks: int = 4) -> DataFrame:
    """Whole-pixel shift of each horizontal block of each frame, from images without their column means."""
    rows = frames.join(references, "movie").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cuts = np.linspace(0, height, blocks + 1).astype(int)

    def kernel(values, reference, block):
        a, b = (p[cuts[block] : cuts[block + 1]] for p in (R.image(reference, height), np.sqrt(np.maximum(R.image(values, height), 0))))
        return R.subpixel_shift(a - a.mean(axis=0), b - b.mean(axis=0), 1)

    return R.per_frame(rows, kernel, ["values", "reference", "block"], "dy double, dx double", ("movie", "frame", "block"))


def recursive_mean(frames: DataFrame, height: int) -> DataFrame:
    """(``movie``, ``image``, ``n``): neighbours in time are aligned on whole pixels and averaged by their counts, then those
    means in turn, until one image is left.  A round is one shuffle, a group in a task is at most two images, and each
    round halves the rows."""
    order = F.row_number().over(Window.partitionBy("movie").orderBy("frame")) - 1
    now = frames.select("movie", order.cast("long").alias("k"), F.col("values").alias("image"), F.lit(1).cast("long").alias("n"))
    longest = now.agg(F.max("k")).first()[0] or 0

    def of(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("k")
        first, n = R.image(pair["image"].iloc[0], height), int(pair["n"].iloc[0])
        if len(pair) == 2:
            other, m = R.image(pair["image"].iloc[1], height), int(pair["n"].iloc[1])
            shift = R.subpixel_shift(first, other, 1)
            moved = np.roll(other, [int(round(s)) for s in shift], axis=(0, 1))
            first, n = first + (moved - first) * (m / (n + m)), n + m
        return pd.DataFrame({"movie": [pair["movie"].iloc[0]], "k": [int(pair["k"].iloc[0]) // 2], "image": [R.flat(first)], "n": [n]})

    schema = f"movie {dict(frames.dtypes)['movie']}, k long, image array<double>, n long"
    for _ in range(int(longest).bit_length()):
        now = now.groupBy("movie", F.shiftright("k", 1).alias("pair")).applyInPandas(of, schema)
    return now.select("movie", "image", "n")


def control_point_affine(points: DataFrame) -> DataFrame:
    """(``movie``, ``matrix``): the 2 x 3 affine map that takes (``y``, ``x``) to (``y2``, ``x2``) with least squared error;
    null for fewer than three points."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        fit = None
        if len(rows) >= 3:
            design = np.column_stack((rows["y"], rows["x"], np.ones(len(rows))))
            fit = np.linalg.lstsq(design, rows[["y2", "x2"]].to_numpy(float), rcond=None)[0].T.reshape(-1).tolist()
        return pd.DataFrame({"movie": [rows["movie"].iloc[0]], "matrix": [fit]})

    return points.groupBy("movie").applyInPandas(of, f"movie {dict(points.dtypes)['movie']}, matrix array<double>")


def correct_recording(frames: DataFrame, height: int, width: int, reference_movie: int, nonrigid: bool = True, bicubic: bool = True, spans: int = 4, smooth: float = 5.0) -> DataFrame:
    """The whole chain: line displacements within each movie, movies onto the reference movie, one resampling.

    ``nonrigid`` adds demons to the affine step; without ``bicubic`` frames are read bilinearly.  A downsampled store of the
    result is ``movie.downsample``.
    """
    lines = kept(R.line_shifts(frames, R.reference_images(frames), height, spans))  # read for the images and again at the end
    pictures = mean_images(R.apply_line_shifts(frames, lines, height))
    return apply_fields(frames, lines, movie_fields(pictures, reference_movie, height, width, nonrigid, smooth), height, bicubic)


#: Whole-recording strategies by name: the arguments of ``correct_recording``.
RECORDING_STRATEGIES = {
    "lines_affine_linear": {"nonrigid": False, "bicubic": False},
    "lines_affine": {"nonrigid": False, "bicubic": True},
    "lines_affine_demons": {"nonrigid": True, "bicubic": True},
}
