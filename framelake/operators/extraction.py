"""Sources and events from recordings, by published methods (the reference only calls such steps; this choice is our own).

Footprints come from non-negative factors of square patches (Cichocki 2009, HALS); traces of given footprints from
non-negative least squares per frame; events from autoregressive deconvolution (first order by pooling adjacent violators,
Friedrich 2017; higher orders by accelerated projected gradients).  A source's noise comes from the upper half of its power
spectrum, its coefficients from autocovariances that noise has no part in, and its penalty is the one at which the residual
is the noise (Pnevmatikakis 2016).  A patch is one group of pixels, a frame one row, a trace one group: what reaches a task is bounded by
the patch area times the frames of one recording, the number of footprints, and the length of a trace.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources.stages import kept

from .movie import synchronised_frames
from .traces import delta_f


def hals(data: np.ndarray, k: int, rounds: int = 60, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors (pixels x k, k x frames) of a non-negative matrix, one component updated at a time."""
    rng = np.random.default_rng(seed)
    space, time = rng.random((data.shape[0], k)) + 0.1, rng.random((k, data.shape[1])) + 0.1
    for _ in range(rounds):
        gram, cross = time @ time.T, data @ time.T
        for j in range(k):
            space[:, j] = np.maximum(space[:, j] + (cross[:, j] - space @ gram[:, j]) / max(gram[j, j], 1e-12), 0)
        gram, cross = space.T @ space, space.T @ data
        for j in range(k):
            time[j] = np.maximum(time[j] + (cross[j] - gram[j] @ time) / max(gram[j, j], 1e-12), 0)
    size = np.maximum(np.linalg.norm(space, axis=0), 1e-12)
    return space / size, time * size[:, None]


def patch_of(px: Column, side: int, height: int, width: int) -> Column:
    """Number of the square patch that a pixel lies in."""
    down = -(-height // side)
    return (F.floor(px % height / side) + F.floor(F.floor(px / height) / side) * down).cast("int")


def footprints(movie: DataFrame, components: int, side: int, height: int, width: int) -> DataFrame:
    """(``patch``, ``component``, ``px``, ``weight``) of each patch; each pixel's series starts at its least value."""
    order = F.transform(F.sort_array(F.collect_list(F.struct("frame", "v"))), lambda s: s["v"])
    series = movie.groupBy("px").agg(order.alias("series")).withColumn("patch", patch_of(F.col("px"), side, height, width))

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("px")
        data = np.stack(rows["series"].to_numpy())
        space, time = hals(data - data.min(axis=1, keepdims=True), min(components, len(rows)))
        order = np.argsort(-np.linalg.norm(time, axis=1), kind="stable")
        px, found = np.repeat(rows["px"].to_numpy(int), len(order)), space[:, order].ravel()
        out = pd.DataFrame({"patch": int(rows["patch"].iloc[0]), "component": np.tile(np.arange(len(order)), len(rows)), "px": px, "weight": found})
        return out[out["weight"] > 1e-10]

    return series.groupBy("patch").applyInPandas(of, "patch int, component int, px int, weight double")


def footprint_traces(movie: DataFrame, weights: DataFrame, rounds: int = 50) -> DataFrame:
    """(``frame``, ``patch``, ``component``, ``f``): the non-negative activity of every footprint in every frame.

    A patch's footprints share no pixel with another's, so each (frame, patch) is solved by itself; the products with the
    movie and among footprints are joins and sums, and only those small tables meet in a task.
    """
    cross = movie.join(weights, "px").groupBy("frame", "patch", "component").agg(F.sum(F.col("v") * F.col("weight")).alias("b"))
    left, right = weights.withColumnsRenamed({"component": "i", "weight": "a"}), weights.withColumnsRenamed({"component": "j", "weight": "c"})
    gram = left.join(right, ["patch", "px"]).groupBy("patch", "i", "j").agg(F.sum(F.col("a") * F.col("c")).alias("g"))
    gram = gram.groupBy("patch").agg(F.sort_array(F.collect_list(F.struct("i", "j", "g"))).alias("gram"))
    rows = cross.groupBy("frame", "patch").agg(F.sort_array(F.collect_list(F.struct("component", "b"))).alias("cross")).join(gram, "patch")

    def of(batches):
        for batch in batches:
            parts = []
            for frame, patch, b, g in batch[["frame", "patch", "cross", "gram"]].itertuples(index=False):
                names = [int(s["component"]) for s in b]
                at = {name: k for k, name in enumerate(names)}
                square, want = np.zeros((len(names), len(names))), np.array([s["b"] for s in b])
                for s in g:
                    square[at[s["i"]], at[s["j"]]] = s["g"]
                got = np.zeros(len(names))
                for _ in range(rounds):
                    for k in range(len(names)):
                        got[k] = max(got[k] + (want[k] - square[k] @ got) / max(square[k, k], 1e-12), 0)
                parts.append(pd.DataFrame({"frame": frame, "patch": patch, "component": names, "f": got}))
            if parts:
                yield pd.concat(parts)

    return rows.mapInPandas(of, f"frame {dict(movie.dtypes)['frame']}, patch int, component int, f double")


def deconvolve(y: np.ndarray, decay: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(calcium, events) that minimise the squared error plus ``penalty`` times the events, with non-negative events and
    calcium that decays by ``decay`` a frame: neighbouring pools merge while one would need a negative event."""
    pools: list[list[float]] = []  # value at the start, weight, start, length
    for t, v in enumerate(y):
        pools.append([v - penalty * ((1 - decay) if t < len(y) - 1 else 1), 1.0, t, 1])
        while len(pools) > 1 and pools[-1][0] < decay ** pools[-2][3] * pools[-2][0]:
            value, weight, _, n = pools.pop()
            last = pools[-1]
            back = decay ** last[3]
            total = last[1] + weight * back**2
            pools[-1] = [(last[1] * last[0] + back * weight * value) / total, total, last[2], last[3] + n]
    calcium = np.concatenate([max(p[0], 0.0) * decay ** np.arange(p[3]) for p in pools]) if pools else np.zeros(0)
    events = calcium - decay * np.concatenate(([0.0], calcium[:-1])) if len(calcium) else calcium
    return calcium, np.where(events < 1e-12, 0.0, events)


def deconvolved(trace: DataFrame, penalty: float = 0.0) -> DataFrame:
    """(``roi_id``, ``frame``, ``denoised``, ``event``, ``decay``); the decay is the autocovariance ratio of lags 2 and 1,
    kept within 0 to 0.98.  The first frame's event is the calcium it starts with."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        y = rows["f"].to_numpy(float)
        low = np.percentile(y, 10)
        off = y - y.mean()
        first, second = (off[k:] @ off[:-k] if len(y) > k else 0.0 for k in (1, 2))
        decay = float(np.clip(second / first if first > 1e-12 else 0.0, 0, 0.98))
        calcium, events = deconvolve(y - low, decay, penalty)
        return pd.DataFrame({"roi_id": rows["roi_id"], "frame": rows["frame"], "denoised": calcium + low, "event": events, "decay": decay})

    # A trace is one source of one recording, which bounds a group by a recording's length.
    kinds = dict(trace.dtypes)
    return trace.where("f IS NOT NULL").groupBy("roi_id").applyInPandas(of, f"roi_id {kinds['roi_id']}, frame {kinds['frame']}, denoised double, event double, decay double")


def noise_level(y: np.ndarray) -> float:
    """Deviation of the white noise of a trace: the mean power of the upper half of its frequencies."""
    if len(y) < 8:
        return float(np.std(np.diff(y)) / np.sqrt(2)) if len(y) > 2 else 0.0
    power = np.abs(np.fft.rfft(y - y.mean())) ** 2 / len(y)
    return float(np.sqrt(power[np.fft.rfftfreq(len(y)) > 0.25].mean()))


def coefficients(y: np.ndarray, order: int, lags: int = 10, most: float = 0.98) -> np.ndarray:
    """Autoregressive coefficients: least squares over the equations of the lags above ``order`` up to ``lags``, in which the
    autocovariance of lag 0, the only one that white noise adds to, has no part.  Roots are brought within ``most``, and for a
    first order the coefficient is not negative."""
    off = y - y.mean()
    lags = min(lags, len(y) - 1)
    if lags <= order:
        return np.zeros(order)
    cov = np.array([off[: len(y) - k] @ off[k:] for k in range(lags + 1)]) / len(y)
    rows = np.array([[cov[k - i] for i in range(1, order + 1)] for k in range(order + 1, lags + 1)])
    g = np.linalg.lstsq(rows, cov[order + 1 :], rcond=None)[0]
    roots = np.roots(np.concatenate(([1.0], -g)))
    size = np.abs(roots)
    roots = np.where(size > most, roots / np.maximum(size, 1e-12) * most, roots)
    if order == 1:
        roots = np.clip(roots.real, 0, most)
    found = -np.poly(roots)[1:].real
    return np.concatenate((found, np.zeros(order - len(found))))


def response(g: np.ndarray, n: int) -> np.ndarray:
    """The calcium that follows one event, over n frames."""
    out = np.zeros(n)
    out[:1] = 1.0
    for t in range(1, n):
        for i, c in enumerate(g[:t], 1):
            out[t] += c * out[t - i]
    return out


def fading(g: np.ndarray, n: int, least: float = 1e-18) -> int:
    """Frames, at most n, after which the response of coefficients ``g`` is below ``least`` (repeated roots too)."""
    widest = float(np.abs(np.roots(np.concatenate(([1.0], -g)))).max(initial=0.0))
    if widest >= 1:
        return n
    return min(n, 2 * int(np.ceil(np.log(least) / np.log(max(widest, 1e-3)))) + 2 * len(g) + 1)


def convolution(wave: np.ndarray, taps: int, block: int):
    """The causal convolution with a response of ``taps`` frames, of which ``wave`` is the spectrum over a block: overlapping
    blocks, so that the cost of a frame does not grow with the trace."""
    step = block - taps + 1

    def of(s: np.ndarray) -> np.ndarray:
        many = -(-len(s) // step)
        padded = np.zeros((many - 1) * step + block)
        padded[taps - 1 : taps - 1 + len(s)] = s
        windows = np.lib.stride_tricks.sliding_window_view(padded, block)[::step]
        return np.fft.irfft(np.fft.rfft(windows, axis=1) * wave, block, axis=1)[:, taps - 1 :].reshape(-1)[: len(s)]

    return of


def deconvolve_any(y: np.ndarray, g: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """As ``deconvolve``, for coefficients of any order."""
    if len(g) == 1:
        return deconvolve(y, float(g[0]), penalty)
    n = len(y)
    size = 1 << (2 * n - 1).bit_length()
    taps = fading(g, n)
    one, block = response(g, taps), max(4096, 1 << (4 * taps - 1).bit_length())
    wave = np.fft.rfft(one, size)
    if block < size:
        grow = convolution(np.fft.rfft(one, block), taps, block)
        back = lambda r: grow(r[::-1])[::-1]
    else:
        grow = lambda s: np.fft.irfft(np.fft.rfft(s, size) * wave, size)[:n]
        back = lambda r: np.fft.irfft(np.fft.rfft(r, size) * np.conj(wave), size)[:n]
    rate = 1.0 / max((np.abs(wave) ** 2).max(), 1e-12)
    events = ahead = np.zeros(n)
    turn = 1.0
    for _ in range(rounds):
        new = np.maximum(ahead - rate * (back(grow(ahead) - y) + penalty), 0)
        later = (1 + np.sqrt(1 + 4 * turn**2)) / 2
        ahead = new + (turn - 1) / later * (new - events)
        if np.abs(new - events).max(initial=0.0) < 1e-7 * max(1.0, np.abs(new).max(initial=0.0)):
            events = new
            break
        events, turn = new, later
    return grow(events), events


def constrained(y: np.ndarray, g: np.ndarray, noise: float, halvings: int = 30) -> tuple[np.ndarray, np.ndarray, float]:
    """(calcium, events, penalty): the largest penalty at which the squared residual is no more than the noise's."""
    room = noise**2 * len(y)
    off = lambda found: float(((y - found[0]) ** 2).sum())
    found, low = deconvolve_any(y, g, 0.0), 0.0
    if off(found) >= room:
        return *found, 0.0
    high = max(float(np.abs(y).max(initial=0.0)), noise) * (1 + 1 / max(1 - np.abs(g).sum(), 0.02))
    for _ in range(halvings):
        mid = (low + high) / 2
        tried = deconvolve_any(y, g, mid)
        if off(tried) <= room:
            low, found = mid, tried
        else:
            high = mid
        if high - low < 1e-4 * high:
            break
    return *found, low


def source_models(trace: DataFrame, order: int = 1, rounds: int = 3) -> DataFrame:
    """One row for each source: ``roi_id``, its ``coefficients``, ``noise``, ``penalty`` and ``baseline``, and arrays
    ``frames``, ``denoised`` and ``events``.  The baseline starts at the trace's 15th percentile and then is the mean of what
    the calcium leaves."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        y = rows["f"].to_numpy(float)
        noise = noise_level(y)
        g = coefficients(y, order)
        level = float(np.percentile(y, 15))
        for _ in range(rounds):
            calcium, events, penalty = constrained(y - level, g, noise)
            level = float((y - calcium).mean())
        one = {"roi_id": rows["roi_id"].iloc[0], "coefficients": g.tolist(), "noise": noise, "penalty": penalty, "baseline": level}
        return pd.DataFrame([one | {"frames": rows["frame"].tolist(), "denoised": (calcium + level).tolist(), "events": events.tolist()}])

    kinds = dict(trace.dtypes)
    schema = f"roi_id {kinds['roi_id']}, coefficients array<double>, noise double, penalty double, baseline double, frames array<{kinds['frame']}>, denoised array<double>, events array<double>"
    # A trace is one source of one recording, which bounds a group and its row by a recording's length.
    return trace.where("f IS NOT NULL").groupBy("roi_id").applyInPandas(of, schema)


def model_traces(models: DataFrame) -> DataFrame:
    """(``roi_id``, ``frame``, ``denoised``, ``event``) of source models."""
    each = models.select("roi_id", F.explode(F.arrays_zip("frames", "denoised", "events")).alias("s"))
    return each.select("roi_id", F.col("s.frames").alias("frame"), F.col("s.denoised").alias("denoised"), F.col("s.events").alias("event"))


def minimal_sync(manifest: DataFrame) -> DataFrame:
    """The frame counts of a recording without synchronisation records: one block, whose frames are all valid."""
    return manifest.agg(F.sum("z").cast("long").alias("slice_frames")).withColumn("valid_frames", F.col("slice_frames"))


def source_results(movie: DataFrame, components: int, side: int, height: int, width: int, order: int = 1, totals: DataFrame | None = None, slice_: int = 0) -> dict[str, DataFrame]:
    """All that a source extraction leaves, by name: ``sources`` (footprint weights of every pixel), ``background`` (the mean of
    what the sources leave, by pixel) and ``background_trace`` (by frame), ``traces`` (activity, its dF/F, denoised and
    events) and ``models`` (coefficients, noise, penalty and baseline, one row for each source).  Results that several of
    them read are computed once.

    With the ``totals`` of ``movie.sync_totals``, only frames that all slices of their block have take part; the movie is of
    ``slice_``, its frames counted within it.
    """
    if totals is not None:
        own = movie.select("frame").distinct().withColumn("slice", F.lit(slice_))
        movie = movie.join(synchronised_frames(own, totals).select("frame"), "frame", "left_semi")
    weights = kept(footprints(movie, components, side, height, width))
    active = kept(footprint_traces(movie, weights))
    explained = active.join(weights, ["patch", "component"]).groupBy("frame", "px").agg(F.sum(F.col("f") * F.col("weight")).alias("own"))
    rest = movie.select("frame", "px", "v").join(explained, ["frame", "px"], "left").withColumn("rest", F.col("v") - F.coalesce("own", F.lit(0.0)))
    named = active.select(F.concat_ws("-", "patch", "component").alias("roi_id"), "frame", "f")
    models = kept(source_models(named, order))
    relative = delta_f(named).select("roi_id", "frame", "f", "df")
    return {
        "sources": weights,
        "background": rest.groupBy("px").agg(F.avg("rest").alias("b")),
        "background_trace": rest.groupBy("frame").agg(F.avg("rest").alias("f")),
        "traces": relative.join(model_traces(models), ["roi_id", "frame"]),
        "models": models.select("roi_id", "coefficients", "noise", "penalty", "baseline"),
    }


def write_results(results: dict[str, DataFrame], path: str) -> None:
    """Every table of an extraction in a folder of its name."""
    for name, table in results.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Tables of a saved extraction, all or some."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names or ("sources", "background", "background_trace", "traces", "models")}
