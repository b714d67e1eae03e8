"""Motion registration: Spark deals frames out, NumPy works on one frame at a time.

Frames are rows with a column-major ``values`` array.  A reference image is a row of its movie and joins the frames by
movie, so memory in a task is one Arrow batch of frames.  Small frames go through a kernel as stacks of one size, which
costs NumPy as many calls as one frame does.  Shifts are data: rows with numbers, applied by another join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.sources.stages import kept

from .images import cubics, flatten_luminance, in_stack

#: Pixels of a stack that a kernel takes at a time.
STACK_PIXELS = 1 << 15


def image(values, height: int) -> np.ndarray:
    """A column-major array as an image."""
    return np.asarray(values, np.float64).reshape(-1, height).T


def images(values: np.ndarray, height: int) -> np.ndarray:
    """Column-major rows as a stack of images."""
    return np.asarray(values, np.float64).reshape(len(values), -1, height).swapaxes(1, 2)


def column_major(picture: np.ndarray) -> np.ndarray:
    """An image as a column-major array, a stack as one row for each."""
    return picture.T.reshape(-1) if picture.ndim == 2 else picture.swapaxes(1, 2).reshape(len(picture), -1)


def flat(picture: np.ndarray) -> list[float]:
    """An image as a column-major list."""
    return column_major(picture).tolist()


def subpixel_shift(reference: np.ndarray, frame: np.ndarray, upsample: int = 50, radius: float | None = None) -> tuple[float, float]:
    """(rows, columns) by which to move ``frame`` onto ``reference``: the peak of their cross-correlation, first on whole
    pixels (within ``radius``, where one is given), then on a grid of 1 / upsample by a matrix Fourier transform within 1.5
    pixels (Guizar-Sicairos 2008)."""
    dy, dx = subpixel_shifts(reference[None], frame[None], upsample, radius)
    return float(dy[0]), float(dx[0])


def subpixel_shifts(references: np.ndarray, frames: np.ndarray, upsample: int = 50, radius: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``subpixel_shift`` of every frame of a stack onto its own reference."""
    a, b = (np.fft.fft2(p - p.mean(axis=(1, 2), keepdims=True)) for p in (references, frames))
    product = a * np.conj(b)
    n, h, w = product.shape
    strength = np.abs(np.fft.ifft2(product))
    if radius is not None:
        far = [np.abs(np.fft.fftfreq(m, 1 / m)) for m in (h, w)]
        strength = np.where(np.hypot(far[0][:, None], far[1][None]) <= radius, strength, -1.0)
    peaks = np.unravel_index(strength.reshape(n, -1).argmax(axis=1), (h, w))
    fine = np.arange(-int(1.5 * upsample), int(1.5 * upsample) + 1) / upsample
    rows, cols = (np.where(p > m // 2, p - m, p)[:, None] + fine for p, m in zip(peaks, (h, w), strict=True))
    waves = [np.exp(2j * np.pi * (x[:, :, None] * np.fft.fftfreq(m))) for x, m in ((rows, h), (cols, w))]
    i, j = np.unravel_index(np.abs(waves[0] @ product @ waves[1].swapaxes(1, 2)).reshape(n, -1).argmax(axis=1), (len(fine), len(fine)))
    return rows[np.arange(n), i], cols[np.arange(n), j]


def sample(picture: np.ndarray, rows: np.ndarray, cols: np.ndarray, fill: float = np.nan) -> np.ndarray:
    """Bilinear values of an image at real places; ``fill`` outside.  Of stacks too."""
    h, w = picture.shape[-2:]
    lead = in_stack(picture)
    inside = (rows >= 0) & (rows <= h - 1) & (cols >= 0) & (cols <= w - 1)
    r, c = np.clip(rows, 0, h - 1), np.clip(cols, 0, w - 1)
    r0, c0 = np.minimum(r.astype(int), max(h - 2, 0)), np.minimum(c.astype(int), max(w - 2, 0))
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    y, x = r - r0, c - c0
    corner = [[picture[(*lead, line, place)] for place in (c0, c1)] for line in (r0, r1)]
    out = (1 - y) * ((1 - x) * corner[0][0] + x * corner[0][1]) + y * ((1 - x) * corner[1][0] + x * corner[1][1])
    return np.where(inside, out, fill)


def warp(picture: np.ndarray, d_rows: np.ndarray | float, d_cols: np.ndarray | float, fill: float = np.nan) -> np.ndarray:
    """The image read at each place plus a displacement; of stacks too."""
    rows, cols = np.mgrid[: picture.shape[-2], : picture.shape[-1]].astype(float)
    return sample(picture, rows + d_rows, cols + d_cols, fill)


def compose(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One displacement field that warps like ``first`` and then ``second``: first read (by cubics) at second's places, plus
    second.  Of stacks too."""
    rows, cols = np.mgrid[: first[0].shape[-2], : first[0].shape[-1]].astype(float)
    read = cubics(list(first), rows + second[0], cols + second[1])
    return tuple(np.nan_to_num(f) + s for f, s in zip(read, second, strict=True))


def line_basis(height: int, spans: int) -> np.ndarray:
    """Linear spline basis over the lines of a frame, one column for each knot."""
    at = np.linspace(0, spans, height)
    return np.maximum(1 - np.abs(at[:, None] - np.arange(spans + 1)[None]), 0)


def line_displacement(reference: np.ndarray, frame: np.ndarray, spans: int = 4, rounds: int = 50, damping: float = 1.0, radius: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Displacements of every line (rows, columns) and the final correlation: Gauss-Newton on knots of a linear spline,
    with a ridge of 1e-4 times the squared median of the reference, stopped when a round raises the correlation by less than
    5e-4.  ``damping`` scales the steps, ``radius`` bounds the shift that they start from."""
    dy, dx, r = line_displacements(reference[None], frame[None], spans, rounds, damping, radius)
    return dy[0], dx[0], float(r[0])


def line_displacements(references: np.ndarray, frames: np.ndarray, spans: int = 4, rounds: int = 50, damping: float = 1.0, radius: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_displacement`` of every frame of a stack on its own reference; a frame that has stopped leaves the rounds."""
    n, h, _ = frames.shape
    basis = line_basis(h, spans)
    p = np.stack([np.repeat(-s[:, None], spans + 1, axis=1) for s in subpixel_shifts(references, frames, 10, radius)])
    ridge = 1e-4 * np.maximum(np.median(references.reshape(n, -1), axis=1) ** 2, 1e-6)[:, None, None] * np.eye(spans + 1)
    top, best, before, left = np.full(n, -np.inf), p.copy(), np.full(n, -np.inf), np.arange(n)
    for k in range(rounds):
        reference = references[left]
        moved = warp(frames[left], *((q[left] @ basis.T)[:, :, None] for q in p))
        ok = ~np.isnan(moved)
        filled = np.where(ok, moved, reference)
        r = correlations(filled, reference)
        better = left[r > top[left]]
        top[left] = np.where(r > top[left], r, top[left])
        best[:, better] = p[:, better]
        on = ~(r < before[left] + 5e-4) if k >= 5 else np.ones(len(left), bool)
        before[left] = r
        left, reference, filled, ok = left[on], reference[on], filled[on], ok[on]
        if not len(left):
            break
        slopes = np.gradient(filled, axis=(1, 2))
        off = reference - filled
        for axis in (0, 1):
            slope = slopes[axis] * ok
            weight = (slope**2).sum(axis=2)
            normal = (basis * weight[:, :, None]).swapaxes(1, 2) @ basis + ridge[left]
            p[axis, left] += damping * np.linalg.solve(normal, basis.T @ (off * slope).sum(axis=2)[:, :, None])[:, :, 0]
    return best[0] @ basis.T, best[1] @ basis.T, top


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of each image of a stack with the other stack's; 0 where one of them is constant."""
    off = np.stack([p.reshape(len(p), -1) for p in (a, b)], axis=1)
    off = off - off.mean(axis=2, keepdims=True)
    both = off @ off.swapaxes(1, 2)
    size = np.sqrt(both[:, 0, 0]) * np.sqrt(both[:, 1, 1])
    flat = (a.std(axis=(1, 2)) == 0) | (b.std(axis=(1, 2)) == 0)
    return np.where(flat, 0.0, np.clip(both[:, 0, 1] / np.where(flat, 1.0, size), -1, 1))


def views(column: pa.Array) -> list:
    """A column's values; lists of numbers as arrays over the column's own memory, missing numbers as not a number."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    values = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    there = column.is_valid().to_pylist()
    return [values[a:b] if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), there, strict=True)]


def column_of(values: tuple) -> pa.Array:
    """Results as a column; arrays become lists, in which what is not a number is missing."""
    if not isinstance(values[0], np.ndarray):
        return pa.array(values)
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), from_pandas=True))


def per_frame(frames: DataFrame, kernel: Callable[..., tuple], inputs: list[str], schema: str, keep: tuple[str, ...] = ("movie", "frame")) -> DataFrame:
    """Rows of a kernel that maps the ``inputs`` of each row to a tuple of new columns."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kernel(*row) for row in zip(*(views(batch.column(c)) for c in inputs), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(column_of, zip(*rows, strict=True))], names)

    kinds = dict(frames.dtypes)
    whole = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", " + schema
    names = [part.split()[0] for part in whole.split(", ")]
    return frames.select(*keep, *[c for c in inputs if c not in keep]).mapInArrow(of, whole)


def per_stack(frames: DataFrame, kernel: Callable[..., tuple], inputs: list[str], schema: str, keep: tuple[str, ...] = ("movie", "frame")) -> DataFrame:
    """As ``per_frame``, for a kernel over many rows at a time: its arguments and results have a row for each.  Rows come in
    stacks of at most ``STACK_PIXELS`` numbers in any argument, in which lists of an argument are equally long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [views(batch.column(c)) for c in inputs]
            sizes = [tuple(len(v) if isinstance(v, np.ndarray) else 1 for v in row) for row in zip(*columns, strict=True)]
            start, stacks = 0, []
            for k in range(1, len(sizes) + 1):
                if k == len(sizes) or sizes[k] != sizes[start] or (k - start + 1) * max(sizes[start]) > STACK_PIXELS:
                    stacks.append(slice(start, k))
                    start = k
            for own in stacks:
                found = kernel(*(np.stack(c[own]) for c in columns))
                rows = batch.slice(own.start, own.stop - own.start)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *map(stack_column, found)], names)

    kinds = dict(frames.dtypes)
    whole = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", " + schema
    names = [part.split()[0] for part in whole.split(", ")]
    return frames.select(*keep, *[c for c in inputs if c not in keep]).mapInArrow(of, whole)


def stack_column(values: np.ndarray) -> pa.Array:
    """Results of a stack as a column; rows of several numbers become lists, in which what is not a number is missing."""
    if values.ndim == 1:
        return pa.array(values)
    ends = np.arange(len(values) + 1) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.reshape(-1), from_pandas=True))


def steady(mean: Column) -> Column:
    """A mean to 30 binary digits.  After a shuffle its terms are added in any order, and a search that starts from the last
    digits of a sum can end elsewhere in the next run."""
    far = mean * F.lit(float(2**23 + 1))
    return far - (far - mean)


def reference_images(frames: DataFrame) -> DataFrame:
    """Mean image of the square root of each movie, as one array for each movie."""
    px = frames.select("movie", F.posexplode("values").alias("px", "v"))
    means = px.groupBy("movie", "px").agg(steady(F.avg(F.sqrt(F.greatest("v", F.lit(0.0))))).alias("m"))
    return means.groupBy("movie").agg(F.transform(F.sort_array(F.collect_list(F.struct("px", "m"))), lambda s: s["m"]).alias("reference"))


def frame_shifts(frames: DataFrame, references: DataFrame, height: int, upsample: int = 50) -> DataFrame:
    """Whole-frame shift (``dy``, ``dx``) of every frame onto its movie's reference."""

    def kernel(values, reference):
        return subpixel_shift(image(reference, height), np.sqrt(np.maximum(image(values, height), 0)), upsample)

    return per_frame(frames.join(references, "movie"), kernel, ["values", "reference"], "dy double, dx double")


def segment_shifts(frames: DataFrame, references: DataFrame, height: int, width: int, upsample: int = 50) -> DataFrame:
    """Consensus shift: the median over 2 x 3 overlapping half-size boxes, each registered by itself."""
    boxes = [(r, c) for r in (0, height // 2) for c in (0, width // 4, width // 2)]
    rows = frames.join(references, "movie").withColumn("box", F.explode(F.array(*[F.lit(k) for k in range(len(boxes))])))

    def kernel(values, reference, box):
        r, c = boxes[box]
        part = np.s_[r : r + height - height // 2, c : c + width - width // 2]
        return subpixel_shift(image(reference, height)[part], np.sqrt(np.maximum(image(values, height), 0))[part], upsample)

    found = per_frame(rows, kernel, ["values", "reference", "box"], "dy double, dx double")
    return found.groupBy("movie", "frame").agg(F.median("dy").alias("dy"), F.median("dx").alias("dx"))


def reject_unrealistic(shifts: DataFrame, most: float = 10.0) -> DataFrame:
    """Shifts beyond ``most`` pixels on either axis become 0."""
    wild = (F.abs("dy") > most) | (F.abs("dx") > most)
    return shifts.withColumns({c: F.when(wild, 0.0).otherwise(F.col(c)) for c in ("dy", "dx")})


def apply_shifts(frames: DataFrame, shifts: DataFrame, height: int) -> DataFrame:
    """Frames moved by their shifts; places from outside are null."""

    def kernel(values, dy, dx):
        return (column_major(warp(image(values, height), -dy, -dx)),)

    return per_frame(frames.join(shifts, ["movie", "frame"]), kernel, ["values", "dy", "dx"], "values array<double>", ("movie", "frame"))


def line_shifts(frames: DataFrame, references: DataFrame, height: int, spans: int = 4, damping: float = 1.0, radius: float | None = None) -> DataFrame:
    """Within-frame displacement of every line: ``dy`` and ``dx`` arrays, and the correlation reached.  The older form has
    16 spans, undamped steps and a radius of 10."""

    def kernel(values, reference):
        return line_displacements(images(reference, height), np.sqrt(np.maximum(images(values, height), 0)), spans, damping=damping, radius=radius)

    return per_stack(frames.join(references, "movie"), kernel, ["values", "reference"], "dy array<double>, dx array<double>, r double")


def apply_line_shifts(frames: DataFrame, shifts: DataFrame, height: int) -> DataFrame:
    """Frames resampled along their lines' displacements."""

    def kernel(values, dy, dx):
        return (column_major(warp(images(values, height), dy[:, :, None], dx[:, :, None])),)

    return per_stack(frames.join(shifts.select("movie", "frame", "dy", "dx"), ["movie", "frame"]), kernel, ["values", "dy", "dx"], "values array<double>")


def flattened_frames(frames: DataFrame, height: int, sigma: float | None = None) -> DataFrame:
    """Frames over their local mean, 0 where that is not finite; by default the mean reaches over a twelfth of the height."""
    reach = round(height / 12) if sigma is None else sigma

    def kernel(values):
        return (column_major(flatten_luminance(image(values, height), reach)),)

    return per_frame(frames, kernel, ["values"], "values array<double>")


#: Motion strategies by name: how frames and references give shifts, and how shifts apply.
STRATEGIES: dict[str, tuple[Callable[..., DataFrame], Callable[..., DataFrame]]] = {
    "full_frame": (lambda f, r, h, w: frame_shifts(f, r, h), apply_shifts),
    "segment_consensus": (segment_shifts, apply_shifts),
    "within_frame": (lambda f, r, h, w: line_shifts(f, r, h), apply_line_shifts),
    "within_frame_fine": (lambda f, r, h, w: line_shifts(f, r, h, 16, 1.0, 10.0), apply_line_shifts),
}


def register_strategy(name: str, identify: Callable[..., DataFrame], apply: Callable[..., DataFrame] = apply_shifts) -> None:
    """Adds a strategy of one's own: ``identify(frames, references, height, width)`` gives rows of (``movie``, ``frame``) with
    what ``apply(frames, shifts, height)`` reads."""
    STRATEGIES[name] = (identify, apply)


def movie_shifts(frames: DataFrame, reference_movie: int, height: int, upsample: int = 50) -> DataFrame:
    """Shift (``movie``, ``my``, ``mx``) of each movie's mean image onto the reference movie's; 0 for that movie itself."""
    px = frames.select("movie", F.posexplode("values").alias("px", "v"))
    means = px.groupBy("movie", "px").agg(steady(F.avg("v")).alias("m"))
    means = means.groupBy("movie").agg(F.transform(F.sort_array(F.collect_list(F.struct("px", "m"))), lambda s: s["m"]).alias("image"))
    target = means.where(F.col("movie") == reference_movie).select(F.col("image").alias("target"))

    def kernel(movie, picture, target):
        if movie == reference_movie:
            return 0.0, 0.0
        mine, other = np.nan_to_num(image(picture, height)), np.nan_to_num(image(target, height))
        return subpixel_shift(other, mine, upsample)

    # The reference is one row.
    return per_frame(means.crossJoin(F.broadcast(target)), kernel, ["movie", "image", "target"], "my double, mx double", ("movie",))


def correct_motion(frames: DataFrame, height: int, width: int, strategy: str = "full_frame", reference_movie: int | None = None) -> DataFrame:
    """Corrected frames by a named strategy, on each movie's own mean image; with ``reference_movie`` the shift of a
    movie's corrected mean onto that movie's is added to its frames' shifts, and frames are resampled once."""
    identify, apply = STRATEGIES[strategy]
    shifts = identify(frames, reference_images(frames), height, width)
    if reference_movie is None:
        return apply(frames, shifts, height)
    shifts = kept(shifts)
    between = movie_shifts(apply(frames, shifts, height), reference_movie, height)
    both = shifts.join(between, "movie")
    if apply is apply_shifts:
        total = {"dy": F.col("dy") + F.col("my"), "dx": F.col("dx") + F.col("mx")}
    else:  # displacements of lines say where a pixel is read, so they go the other way
        total = {"dy": F.transform("dy", lambda d: d - F.col("my")), "dx": F.transform("dx", lambda d: d - F.col("mx"))}
    return apply(frames, both.withColumns(total).drop("my", "mx"), height)
