"""Regions from pixel correlations: normalised cuts and L1 clusters around seeds.

A seed's neighbourhood has a fixed number of pixels, so each group that reaches a task is of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions.compat import pearson

from .baseline import robust_fit


def similarity(r: np.ndarray, side: np.ndarray) -> np.ndarray:
    """exp(-((1 - r) / median(1 - r))**2), one more for side neighbours."""
    gap = 1 - np.nan_to_num(r)
    middle = np.median(gap[~np.eye(len(r), dtype=bool)]) if len(r) > 1 else 1.0
    return np.exp(-((gap / (middle or 1.0)) ** 2)) + side


def cuts(weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n smallest non-trivial solutions of (D - W) x = lambda D x, scaled by 1 / (lambda + 0.01), and lambdas."""
    degree = weights.sum(axis=1)
    root = 1 / np.sqrt(degree)
    values, vectors = np.linalg.eigh(np.eye(len(weights)) - root[:, None] * weights * root[None])
    keep = slice(1, min(n + 1, len(values)))
    chosen = vectors[:, keep] * root[:, None]
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    return chosen * np.where(signs == 0, 1, signs) / (values[keep] + 0.01), values[keep]


def l1_clusters(points: np.ndarray, k: int, rounds: int = 100, seed: int = 0, replicates: int = 10) -> np.ndarray:
    """K-medians under the L1 distance; starts are the points farthest from the median on each axis.  Where more are
    needed, random ones are added ``replicates`` times, and the clusters of the least summed distance are kept."""
    rng = np.random.default_rng(seed)
    far = np.abs(points - np.median(points, axis=0)).argmax(axis=0)
    starts = list(dict.fromkeys(far.tolist()))[:k]
    if len(starts) == min(k, len(points)):
        return k_medians(points, starts, rounds)[0]
    others = np.setdiff1d(np.arange(len(points)), starts)
    tries = [k_medians(points, starts + rng.permutation(others)[: k - len(starts)].tolist(), rounds) for _ in range(replicates)]
    return min(tries, key=lambda found: found[1])[0]


def k_medians(points: np.ndarray, starts: list[int], rounds: int) -> tuple[np.ndarray, float]:
    """Cluster of every point, and the summed distance to the centres."""
    centres, own = points[starts].copy(), np.zeros(len(points), int)
    for _ in range(rounds):
        new = np.abs(points[:, None] - centres[None]).sum(axis=2).argmin(axis=1)
        if (new == own).all() and _:
            break
        own = new
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = np.median(points[own == c], axis=0)
    return own, float(np.abs(points - centres[own]).sum())


def silhouette(points: np.ndarray, own: np.ndarray) -> float:
    """Mean silhouette under the L1 distance; 0 for a point alone in its cluster."""
    labels = np.unique(own)
    if len(labels) < 2:
        return 0.0
    apart = np.abs(points[:, None] - points[None]).sum(axis=2)
    sums = np.stack([apart[:, own == c].sum(axis=1) for c in labels], axis=1)
    sizes = np.array([(own == c).sum() for c in labels])
    at = np.searchsorted(labels, own)
    inner = sums[np.arange(len(own)), at] / np.maximum(sizes[at] - 1, 1)
    outer = sums / sizes
    outer[np.arange(len(own)), at] = np.inf
    near = outer.min(axis=1)
    score = np.where(sizes[at] > 1, (near - inner) / np.maximum(np.maximum(near, inner), 1e-12), 0)
    return float(score.mean())


def largest_part(mask: np.ndarray) -> np.ndarray:
    """The largest 8-connected part of a mask (first in reading order among equals)."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        padded = np.pad(label, 1)
        views = [padded[r : r + mask.shape[0], c : c + mask.shape[1]] for r in range(3) for c in range(3)]
        high = np.where(mask, np.max(views, axis=0), 0)
        if (high == label).all():
            break
        label = high
    values, counts = np.unique(label[mask], return_counts=True)
    return (label == values[counts.argmax()]) if len(values) else mask


def seed_neighbourhoods(correlation: DataFrame, seeds: DataFrame, neighbourhood: int, height: int, width: int) -> DataFrame:
    """Stored correlations whose two pixels both lie in a seed's square, by ``seed``."""
    half = neighbourhood // 2
    steps = F.sequence(F.lit(-half), F.lit(half))
    around = seeds.select(F.col("px").alias("seed"), F.explode(steps).alias("dr")).select("seed", "dr", F.explode(steps).alias("dc"))
    row, col = F.col("seed") % height + F.col("dr"), F.floor(F.col("seed") / height) + F.col("dc")
    around = around.where((row >= 0) & (row < height) & (col >= 0) & (col < width)).select("seed", (row + col * height).cast("int").alias("p"))
    first, second = around.withColumnRenamed("p", "px_i"), around.select(F.col("seed").alias("seed2"), F.col("p").alias("px_j"))
    return correlation.join(first, "px_i").join(second, (correlation["px_j"] == second["px_j"]) & (F.col("seed") == F.col("seed2"))).select("seed", "px_i", correlation["px_j"], "r")


def count_cuts(values: np.ndarray) -> int:
    """How many eigenvalues lie below a robust line through all of them by ten of its deviations: the last such place."""
    if len(values) < 4:
        return max(len(values), 1)
    x = np.arange(1, len(values) + 1, dtype=float)
    design = np.column_stack((x, np.ones(len(x))))
    line = design @ robust_fit(design, values, 2.0)
    low = np.flatnonzero(values < line - 10 * np.median(np.abs(values - line)) / 0.6745)
    return int(low[-1]) + 1 if len(low) else 1


def cluster_seeds(pairs: DataFrame, height: int, n_cuts: int = 3, more: int = 0, excluded: int = 0) -> DataFrame:
    """(``seed``, ``px``, ``cluster``): the best silhouette of n_cuts .. n_cuts + 2 clusters, at least n_cuts + 1 of them.

    ``n_cuts`` of 0 counts the cuts from the eigenvalues of up to 20.
    """

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        px = np.unique(frame[["px_i", "px_j"]].to_numpy())
        i, j = np.searchsorted(px, frame["px_i"]), np.searchsorted(px, frame["px_j"])
        r = np.zeros((len(px), len(px)))
        r[i, j] = r[j, i] = np.nan_to_num(frame["r"].to_numpy(float))
        np.fill_diagonal(r, 1)
        rows, cols = px % height, px // height
        side = (np.abs(rows[:, None] - rows[None]) + np.abs(cols[:, None] - cols[None])) == 1
        vectors, values = cuts(similarity(r, side.astype(float)), n_cuts or 20)
        n = n_cuts or count_cuts(values)
        vectors = vectors[:, excluded:n] if min(vectors.shape[1], n) > excluded else vectors[:, :n]
        tries = [l1_clusters(vectors, min(max(2, n + m + more), len(px))) for m in range(3)] if len(px) > 2 else [np.zeros(len(px), int)]
        best = max(range(len(tries)), key=lambda t: silhouette(vectors, tries[t]))
        own = tries[max(best, min(1, len(tries) - 1))]
        return pd.DataFrame({"seed": frame["seed"].iloc[0], "px": px.astype(int), "cluster": own})

    kind = dict(pairs.dtypes)["seed"]
    return pairs.groupBy("seed").applyInPandas(of, f"seed {kind}, px int, cluster int")


def region_of(clusters: DataFrame, height: int, width: int) -> DataFrame:
    """The largest connected part of the seed's own cluster."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        seed = int(frame["seed"].iloc[0])
        own = frame.loc[frame["px"] == seed, "cluster"]
        px = frame.loc[frame["cluster"].isin(own), "px"].to_numpy(int)
        mask = np.zeros((height, width), bool)
        mask[px % height, px // height] = True
        kept = largest_part(mask)
        return pd.DataFrame({"seed": seed, "px": px[kept[px % height, px // height]]})

    kind = dict(clusters.dtypes)["seed"]
    return clusters.groupBy("seed").applyInPandas(of, f"seed {kind}, px int")


def merge_clusters(clusters: DataFrame, keep: int, gone: int) -> DataFrame:
    """Cluster ``gone`` becomes ``keep``; later numbers close the gap."""
    c = F.when(F.col("cluster") == gone, keep).otherwise(F.col("cluster"))
    return clusters.withColumn("cluster", F.when(c > gone, c - 1).otherwise(c))


def save_region(regions: DataFrame, body: list[int], neuropil: list[int], group: int, coefficient: float) -> DataFrame:
    """``regions`` with one more, its id one above the highest (1 in an empty table)."""
    top = regions.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("int").alias("id"))
    arrays = {"ind_body": body, "ind_neuropil": neuropil}
    new = top.withColumns({"grp": F.lit(group), **{k: F.array(*[F.lit(int(x)) for x in v]).cast("array<int>") for k, v in arrays.items()}, "sub_coef": F.lit(float(coefficient))})
    return regions.unionByName(new)


def covered_regions(labels: DataFrame, mask: DataFrame) -> DataFrame:
    """(``label``, ``n``, ``hits``): the pixels of every region of a label image, and those that a mask has too."""
    inside = labels.join(mask.select("px").distinct().withColumn("hit", F.lit(1)), "px", "left")
    return inside.groupBy("label").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))


def swallowed(labels: DataFrame, mask: DataFrame) -> DataFrame:
    """Regions of a label image that a new mask would cover completely."""
    return covered_regions(labels, mask).where("n = hits").select("label")


def split_cluster(clusters: DataFrame, pairs: DataFrame, cluster: int) -> DataFrame:
    """One cluster of each seed in two by its second cut on the raw correlations; the larger half keeps the number and
    the other one gets the next free number of the seed."""
    own = clusters.where(F.col("cluster") == cluster)
    first, second = own.select("seed", F.col("px").alias("px_i")), own.select("seed", F.col("px").alias("px_j"))
    inner = pairs.join(first, ["seed", "px_i"]).join(second, ["seed", "px_j"])

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        px = np.unique(frame[["px_i", "px_j"]].to_numpy())
        i, j = np.searchsorted(px, frame["px_i"]), np.searchsorted(px, frame["px_j"])
        r = np.zeros((len(px), len(px)))
        r[i, j] = r[j, i] = np.nan_to_num(frame["r"].to_numpy(float))
        np.fill_diagonal(r, 1)
        half = np.zeros(len(px), int)
        if len(px) > 1:
            vectors, _ = cuts(np.maximum(r, 1e-9), 1)
            half = l1_clusters(vectors, 2)
        minor = half != np.bincount(half).argmax()
        return pd.DataFrame({"seed": frame["seed"].iloc[0], "px": px.astype(int), "minor": minor})

    halves = inner.groupBy("seed").applyInPandas(of, f"seed {dict(clusters.dtypes)['seed']}, px int, minor boolean")
    top = clusters.groupBy("seed").agg((F.max("cluster") + 1).cast("int").alias("next"))
    moved = clusters.join(halves.where("minor"), ["seed", "px"], "left").join(top, "seed")
    return moved.select("seed", "px", F.when(F.col("minor"), F.col("next")).otherwise(F.col("cluster")).alias("cluster"))


def background_cluster(features: DataFrame) -> DataFrame:
    """(``seed``, ``background``): of the clusters other than the one with the seed's own pixel, the one whose centroid has
    the least L2 norm (the smaller number on ties).  ``features``: ``seed``, ``px``, ``cluster``, ``vector``."""
    at = features.select("seed", "px", "cluster", F.posexplode("vector").alias("axis", "x"))
    centre = at.groupBy("seed", "cluster", "axis").agg(F.avg("x").alias("m"))
    norms = centre.groupBy("seed", "cluster").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    body = features.where("px = seed").select("seed", "cluster")
    return norms.join(body, ["seed", "cluster"], "left_anti").groupBy("seed").agg(F.min(F.struct("norm", "cluster"))["cluster"].alias("background"))


def second_largest(clusters: DataFrame) -> DataFrame:
    """(``seed``, ``cluster``, ``n``): each seed's second largest cluster, the smaller number first on ties."""
    sizes = clusters.groupBy("seed", "cluster").agg(F.count("*").alias("n"))
    order = Window.partitionBy("seed").orderBy(F.desc("n"), "cluster")
    return sizes.withColumn("place", F.row_number().over(order)).where("place = 2").drop("place")


def movie_correlations(movie: DataFrame, pixels: DataFrame) -> DataFrame:
    """Correlations, straight from the movie, of all pairs i <= j in each seed's own list of pixels (``seed``, ``px``).

    A seed's list is a neighbourhood of fixed size.  A frame's values of one list come together once, as an array, and are paired
    there, so that what is shuffled grows with the pixels of the lists and not with their pairs.
    """
    own = pixels.distinct()
    values = movie.select("frame", "px", "v").join(own, "px").groupBy("seed", "frame").agg(F.collect_list(F.struct("px", "v")).alias("near"))
    paired = values.select("seed", "near", F.explode("near").alias("a")).select("seed", "a", F.explode("near").alias("b")).where("a.px <= b.px")
    found = paired.groupBy("seed", F.col("a.px").alias("px_i"), F.col("b.px").alias("px_j")).agg(pearson(F.col("a.v"), F.col("b.v")).alias("r"))
    times = pixels.groupBy("seed", "px").agg(F.count("*").alias("n"))  # a pixel that a list names twice has its pairs twice
    left, right = times.withColumnsRenamed({"px": "px_i", "n": "n_i"}), times.withColumnsRenamed({"px": "px_j", "n": "n_j"})
    whole = found.join(left, ["seed", "px_i"]).join(right, ["seed", "px_j"])
    return whole.select("seed", "px_i", "px_j", "r", F.explode(F.sequence(F.lit(1), F.col("n_i") * F.col("n_j")))).drop("col")


def inside_polygon(row: Column, col: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a place lies inside a polygon, by the parity of the sides that a ray along the row crosses."""
    crossed = F.lit(0)
    for (r0, c0), (r1, c1) in zip(corners, corners[1:] + corners[:1], strict=True):
        if r0 != r1:
            at = (row - F.lit(float(r0))) * F.lit((c1 - c0) / (r1 - r0)) + F.lit(float(c0))
            crossed = crossed + F.when(((F.lit(float(r0)) > row) != (F.lit(float(r1)) > row)) & (col < at), 1).otherwise(0)
    return crossed % 2 == 1


def clamped_seeds(seeds: DataFrame, neighbourhood: int, height: int, width: int) -> DataFrame:
    """Seeds (``row_``, ``col_``) within the image, moved in as far as their neighbourhood needs; others are left out."""
    margin = neighbourhood // 2
    inside = seeds.where((F.col("row_") >= 0) & (F.col("row_") < height) & (F.col("col_") >= 0) & (F.col("col_") < width))
    moved = {c: F.least(F.greatest(F.col(c), F.lit(margin)), F.lit(n - 1 - margin)) for c, n in (("row_", height), ("col_", width))}
    return inside.withColumns(moved)


def seed_grid(spark: SparkSession, step: int, height: int, width: int) -> DataFrame:
    """(``seed``, ``row_``, ``col_``): centres of a grid of squares of ``step`` pixels, column by column."""
    down, across = round(height / step), round(width / step)
    ids = spark.range(down * across).select(F.col("id").cast("int").alias("seed"))
    half = (step - 1) / 2
    return ids.select("seed", (F.col("seed") % down * step + half).alias("row_"), (F.floor(F.col("seed") / down) * step + half).alias("col_"))


def nearest_seed(row: Column, col: Column, step: int, height: int, width: int) -> Column:
    """Number of the grid seed whose square holds a place (the last one beyond the grid)."""
    down, across = round(height / step), round(width / step)
    r, c = (F.least(F.floor(x / step), F.lit(n - 1)) for x, n in ((row, down), (col, across)))
    return (r + c * down).cast("int")


def seed_discs(spark: SparkSession, step: int, radius: float, height: int, width: int) -> DataFrame:
    """(``seed``, ``px``): pixels nearer to a seed than ``radius``; offsets come from the seed, so nothing is compared that
    lies outside its square."""
    reach = F.sequence(F.lit(-int(radius) - 1), F.lit(int(radius) + 1))
    near = seed_grid(spark, step, height, width).select("*", F.explode(reach).alias("dr")).select("*", F.explode(reach).alias("dc"))
    near = near.withColumns({"r": F.floor("row_") + F.col("dr"), "c": F.floor("col_") + F.col("dc")})
    near = near.where((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width))
    far = (F.col("r") - F.col("row_")) ** 2 + (F.col("c") - F.col("col_")) ** 2
    return near.where(far < radius**2).select("seed", (F.col("r") + F.col("c") * height).cast("int").alias("px"))


def seed_covariance(bins: DataFrame, discs: DataFrame) -> DataFrame:
    """Covariance of all pairs i <= j in each seed's disc: population covariance over the bins of each movie, averaged over
    movies.  A pair that several seeds share is computed once."""
    left, right = discs.select("seed", F.col("px").alias("px_i")), discs.select("seed", F.col("px").alias("px_j"))
    pairs = left.join(right, "seed").where("px_i <= px_j")
    a = bins.select("movie", "bin", F.col("px").alias("px_i"), F.col("v").alias("a"))
    b = bins.select("movie", "bin", F.col("px").alias("px_j"), F.col("v").alias("b"))
    per_movie = pairs.select("px_i", "px_j").distinct().join(a, "px_i").join(b, ["px_j", "movie", "bin"]).groupBy("movie", "px_i", "px_j").agg(F.covar_pop("a", "b").alias("c"))
    cov = per_movie.groupBy("px_i", "px_j").agg(F.avg("c").alias("cov"))
    return pairs.join(cov, ["px_i", "px_j"]).select("seed", "px_i", "px_j", "cov")


def region_window(pixels: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """(``roi_id``, ``top``, ``bottom``, ``left``, ``right``): the square around each body's rounded centroid, cut at the image."""
    body = pixels.where("kind = 'body'")
    centre = body.groupBy("roi_id").agg(F.round(F.avg(F.col("px") % height)).cast("int").alias("r"), F.round(F.avg(F.floor(F.col("px") / height))).cast("int").alias("c"))
    low, high = (lambda x: F.greatest(x - radius, F.lit(0))), (lambda x, n: F.least(x + radius, F.lit(n - 1)))
    return centre.select("roi_id", low(F.col("r")).alias("top"), high(F.col("r"), height).alias("bottom"), low(F.col("c")).alias("left"), high(F.col("c"), width).alias("right"))


def region_movie(movie: DataFrame, windows: DataFrame) -> DataFrame:
    """Pixels of the window around each region in every frame; windows give their pixels first and meet the movie by key."""
    places = windows.select("roi_id", F.explode(F.sequence("top", "bottom")).alias("row_"), "left", "right")
    places = places.select("roi_id", "row_", F.explode(F.sequence("left", "right")).alias("col_"))
    return movie.join(places, ["row_", "col_"]).select("roi_id", "frame", "row_", "col_", "v")


def migrate_regions(old: DataFrame) -> DataFrame:
    """One row per region from parallel arrays ``ids`` and ``groups`` of an older table; the arrays are dropped."""
    each = old.select("*", F.explode(F.arrays_zip("ids", "groups")).alias("one"))
    return each.select(*[c for c in old.columns if c not in ("ids", "groups")], F.col("one.ids").alias("id"), F.col("one.groups").alias("grp"))


def delete_region(regions: DataFrame, gone: int, renumber: bool = False) -> DataFrame:
    """``regions`` without one id; ``renumber`` closes the gap above it."""
    kept = regions.where(F.col("id") != gone)
    return kept.withColumn("id", F.when(F.col("id") > gone, F.col("id") - 1).otherwise(F.col("id"))) if renumber else kept


def relabel_region(regions: DataFrame, region: int, group: int) -> DataFrame:
    """One region in another group."""
    return regions.withColumn("grp", F.when(F.col("id") == region, F.lit(group)).otherwise(F.col("grp")))


def nudge_coefficient(regions: DataFrame, region: int, step: float) -> DataFrame:
    """One region's background coefficient moved by a step."""
    return regions.withColumn("sub_coef", F.when(F.col("id") == region, F.col("sub_coef") + step).otherwise(F.col("sub_coef")))


def clear_labels(labels: DataFrame, gone: int) -> DataFrame:
    """A label image without one region."""
    return labels.where(F.col("label") != gone)


def first_occurrences(items: DataFrame, order_by: str, *keys: str) -> DataFrame:
    """Distinct keys with the place of each one's first occurrence."""
    return items.groupBy(*keys).agg(F.min(order_by).alias(order_by))
