"""Small image helpers for the kernels that Spark runs on one image of a movie, one frame, or a stack of images of one size.

Where a function says so, ``picture`` may be a stack (images x rows x columns), of which each image is treated by itself.
"""

from __future__ import annotations

import numpy as np


def blur(picture: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian smoothing, the edge repeated outside; of stacks too."""
    if sigma <= 0:
        return picture
    reach = int(3 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (picture.ndim - 2, picture.ndim - 1):
        padded = np.pad(picture, [(reach, reach) if a == axis else (0, 0) for a in range(picture.ndim)], mode="edge")
        windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=axis)
        picture = windows @ weights
    return picture


def high_pass(picture: np.ndarray, sigma: float) -> np.ndarray:
    """The image over its local mean."""
    return picture / (blur(picture, sigma) + 1e-2)


def interior_strips(picture: np.ndarray, margin: int) -> np.ndarray:
    """The image with its outer ``margin`` lines on every side replaced by those just within, in their order; corners come
    from within on both axes.  Of stacks too."""
    if margin < 1 or min(picture.shape[-2:]) < 4 * margin:
        return picture
    out = picture.copy()
    for view in (out, out.swapaxes(-1, -2)):
        view[..., :margin, :] = view[..., margin : 2 * margin, :]
        view[..., -margin:, :] = view[..., -2 * margin : -margin, :]
    return out


def halved(picture: np.ndarray) -> np.ndarray:
    """Every other pixel of the slightly blurred image; of stacks too."""
    return blur(picture, 0.8)[..., ::2, ::2]


def flatten_luminance(picture: np.ndarray, sigma: float) -> np.ndarray:
    """The image over its local mean, 0 where that is not finite."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = picture / blur(picture, sigma)
    return np.where(np.isfinite(out), out, 0.0)


def in_stack(picture: np.ndarray) -> tuple[np.ndarray, ...]:
    """The index that leads places of each image of a stack; none for one image."""
    return () if picture.ndim == 2 else (np.arange(len(picture))[:, None, None],)


def cubic(picture: np.ndarray, rows: np.ndarray, cols: np.ndarray, fill: float = np.nan) -> np.ndarray:
    """Bicubic values (Keys 1981, a = -1/2) of an image at real places; ``fill`` outside.  Of stacks too."""
    return cubics([picture], rows, cols, fill)[0]


def cubics(pictures: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, fill: float = np.nan) -> list[np.ndarray]:
    """``cubic`` of several images of one size at the same places."""
    h, w = pictures[0].shape[-2:]
    inside = (rows >= 0) & (rows <= h - 1) & (cols >= 0) & (cols <= w - 1)
    r, c = np.clip(rows, 0, h - 1), np.clip(cols, 0, w - 1)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    steps = range(-1, 3)

    def weight(t: np.ndarray) -> np.ndarray:
        t = np.abs(t)
        return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))

    down, across = [weight(r - r0 - i) for i in steps], [weight(c - c0 - j) for j in steps]
    lines, places = [np.clip(r0 + i, 0, h - 1) for i in steps], [np.clip(c0 + j, 0, w - 1) for j in steps]
    found = []
    for picture in pictures:
        lead = in_stack(picture)
        out = sum(d * sum(a * picture[(*lead, line, place)] for a, place in zip(across, places, strict=True)) for d, line in zip(down, lines, strict=True))
        found.append(np.where(inside, out, fill))
    return found


def equalise(picture: np.ndarray, tiles: int = 8, clip: float = 0.01, bins: int = 256) -> np.ndarray:
    """Contrast-limited adaptive equalisation of an image in [0, 1] (Zuiderveld 1994): a clipped, redistributed histogram
    for each tile, and the four nearest tiles' mappings blended at every pixel."""
    h, w = picture.shape
    tiles_r, tiles_c = min(tiles, h), min(tiles, w)
    level = np.clip((picture * bins).astype(int), 0, bins - 1)
    maps = np.empty((tiles_r, tiles_c, bins))
    for i, rows in enumerate(np.array_split(np.arange(h), tiles_r)):
        for j, cols in enumerate(np.array_split(np.arange(w), tiles_c)):
            counts = np.bincount(level[np.ix_(rows, cols)].ravel(), minlength=bins).astype(float)
            most = max(counts.sum() * clip, counts.sum() / bins)
            over = np.maximum(counts - most, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(counts, most) + over / bins) / counts.sum()
    y = np.clip((np.arange(h) + 0.5) * tiles_r / h - 0.5, 0, tiles_r - 1)[:, None]
    x = np.clip((np.arange(w) + 0.5) * tiles_c / w - 0.5, 0, tiles_c - 1)[None]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles_r - 1), np.minimum(x0 + 1, tiles_c - 1)
    top = (1 - (x - x0)) * maps[y0, x0, level] + (x - x0) * maps[y0, x1, level]
    low = (1 - (x - x0)) * maps[y1, x0, level] + (x - x0) * maps[y1, x1, level]
    return (1 - (y - y0)) * top + (y - y0) * low


def spline_basis(x: np.ndarray, knots: np.ndarray, degree: int, outside: str = "zero") -> np.ndarray:
    """B-spline basis of any degree over ``knots`` by the Cox-de Boor recurrence, one column for each function.

    ``outside``: places beyond the knots' domain give zero, or with ``constant`` the basis at the nearest end.
    """
    knots = np.asarray(knots, float)
    low, high = knots[degree], knots[len(knots) - degree - 1]
    at = np.asarray(x, float)
    inside = (at >= low) & (at <= high)
    at = np.clip(at, low, high)
    span = np.clip(np.searchsorted(knots, at, side="right") - 1, degree, len(knots) - degree - 2)
    basis = (np.arange(len(knots) - 1)[None] == span[:, None]).astype(float)
    for k in range(1, degree + 1):
        wide, next_wide = knots[k:-1] - knots[: -k - 1], knots[k + 1 :] - knots[1:-k]
        up = np.where(wide > 0, (at[:, None] - knots[None, : -k - 1]) / np.where(wide > 0, wide, 1), 0)
        down = np.where(next_wide > 0, (knots[None, k + 1 :] - at[:, None]) / np.where(next_wide > 0, next_wide, 1), 0)
        basis = up * basis[:, :-1] + down * basis[:, 1:]
    return basis if outside == "constant" else basis * inside[:, None]


def spline_slope(knots: np.ndarray, weights: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Knots and weights of the derivative, a spline of one degree less."""
    knots = np.asarray(knots, float)
    wide = knots[degree + 1 : -1] - knots[1 : -degree - 1]
    return knots[1:-1], degree * np.diff(weights) / np.where(wide > 0, wide, 1)


def spline_fit(x: np.ndarray, y: np.ndarray, knots: np.ndarray, degree: int, smooth: float = 0.0) -> np.ndarray:
    """Least-squares weights, with ``smooth`` times the squared second differences of the weights as penalty."""
    basis = spline_basis(x, knots, degree)
    rough = np.diff(np.eye(basis.shape[1]), 2, axis=0)
    rows = np.vstack((basis, np.sqrt(smooth) * rough))
    return np.linalg.lstsq(rows, np.concatenate((y, np.zeros(len(rough)))), rcond=None)[0]


def nearest_positive(matrix: np.ndarray) -> np.ndarray:
    """The nearest symmetric positive definite matrix (Higham 1988), nudged until its Cholesky factor exists."""
    even = (matrix + matrix.T) / 2
    values, vectors = np.linalg.eigh(even)
    near = (vectors * np.maximum(values, 0)) @ vectors.T
    step = max(np.spacing(np.abs(values).max(initial=0.0)), np.finfo(float).tiny)
    while True:
        near = (near + near.T) / 2
        try:
            np.linalg.cholesky(near)
            return near
        except np.linalg.LinAlgError:
            near = near + step * np.eye(len(near))
            step *= 2
