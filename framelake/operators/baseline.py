"""Robust fits per trace: neuropil coefficient and exponential-linear baseline.

A trace is one region in one recording; its frames meet in one task, which bounds a group by a recording's length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.compat import group_percentile

from . import traces


def bisquare(u: np.ndarray) -> np.ndarray:
    """Tukey's weights."""
    return np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0.0)


def talwar(u: np.ndarray) -> np.ndarray:
    """Weights of 1 within the limit and 0 beyond."""
    return (np.abs(u) < 1).astype(float)


def robust_fit(design: np.ndarray, y: np.ndarray, tune: float, weight=bisquare, rounds: int = 50) -> np.ndarray:
    """Iteratively reweighted least squares; residuals are scaled by MAD / 0.6745 and by leverage."""
    q, _ = np.linalg.qr(design)
    leverage = np.sqrt(1 - np.minimum((q**2).sum(axis=1), 0.9999))
    b = np.linalg.lstsq(design, y, rcond=None)[0]
    for _ in range(rounds):
        res = (y - design @ b) / leverage
        scale = max(np.median(np.abs(res)) / 0.6745, 1e-12 * max(np.abs(y).max(initial=0), 1.0))
        root = np.sqrt(weight(res / (tune * scale)))
        new = np.linalg.lstsq(design * root[:, None], y * root, rcond=None)[0]
        if np.allclose(new, b, rtol=1e-8, atol=1e-12):
            return new
        b = new
    return b


def baseline(y: np.ndarray, tune: float = 1.5) -> np.ndarray:
    """Robust fit of constant, line and decay over a trace."""
    x = np.linspace(-1, 1, len(y))
    design = np.column_stack((np.ones(len(y)), x, np.exp(-x)))
    return design @ robust_fit(design, y, tune, talwar) if len(y) > 3 else np.full(len(y), np.median(y) if len(y) else 0.0)


def neuropil_coefficients(traces: DataFrame, tune: float = 2.0) -> DataFrame:
    """(``roi_id``, ``slope``, ``constant``) of ``raw`` on ``neuropil``, null for fewer than three frames."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        ok = frame.dropna(subset=["raw", "neuropil"])
        found = (None, None)
        if len(ok) >= 3:
            found = robust_fit(np.column_stack((ok["neuropil"], np.ones(len(ok)))), ok["raw"].to_numpy(float), tune)
        return pd.DataFrame({"roi_id": [frame["roi_id"].iloc[0]], "slope": [found[0]], "constant": [found[1]]})

    return traces.groupBy("roi_id").applyInPandas(of, f"roi_id {dict(traces.dtypes)['roi_id']}, slope double, constant double")


def baseline_delta_f(traces: DataFrame) -> DataFrame:
    """``df`` = (f - its baseline) / baseline of the uncorrected ``raw`` trace."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("frame")
        f, raw = frame["f"].to_numpy(float), frame["raw"].to_numpy(float)
        under, over = baseline(f), baseline(raw)
        with np.errstate(divide="ignore", invalid="ignore"):
            df = np.where(np.abs(over) > 1e-12, (f - under) / over, np.nan)
        return pd.DataFrame({"roi_id": frame["roi_id"], "frame": frame["frame"], "df": df})

    kinds = dict(traces.dtypes)
    return traces.groupBy("roi_id").applyInPandas(of, f"roi_id {kinds['roi_id']}, frame {kinds['frame']}, df double")


def debleached(traces: DataFrame, *columns: str) -> DataFrame:
    """Each of the columns without its bleaching: its baseline taken off and the baseline's median put back."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("frame")
        for c in columns:
            y = frame[c].to_numpy(float)
            there = np.isfinite(y)
            under = baseline(y[there])
            y[there] = y[there] - under + (np.median(under) if len(under) else 0.0)
            frame[c] = y
        return frame[["roi_id", "frame", *columns]]

    kinds = dict(traces.dtypes)
    return traces.groupBy("roi_id").applyInPandas(of, f"roi_id {kinds['roi_id']}, frame {kinds['frame']}, " + ", ".join(f"{c} double" for c in columns))


def paired_coefficients(pairs: DataFrame, length: int = 5, span: int = 5, percent: float = 10.0, tune: float = 2.0, debleach: bool = True) -> DataFrame:
    """The background coefficient of every region, fitted on quiet frames only; bleaching is removed first.

    Body and background are each taken relative to a low percentile and smoothed; frames whose smoothed change of their
    difference is at most its commonest value are kept; the robust slope comes from those.  All but the last fit is native.
    """
    pairs = debleached(pairs, "raw", "neuropil") if debleach else pairs
    base = group_percentile(pairs, ["roi_id"], "raw", percent, "raw0").join(group_percentile(pairs, ["roi_id"], "neuropil", percent, "neuropil0"), "roi_id")
    centred = pairs.join(base, "roi_id").select("roi_id", "frame", *[(F.col(c) - F.col(f"{c}0")).alias(c) for c in ("raw", "neuropil")])
    quiet = traces.stable_frames(centred.select("roi_id", "frame", (F.col("raw") - F.col("neuropil")).alias("f")), span).select("roi_id", "frame")
    smooth = [traces.gaussian_smooth(centred.select("roi_id", "frame", F.col(c).alias("f")), length).select("roi_id", "frame", F.col("smooth").alias(c)) for c in ("raw", "neuropil")]
    return neuropil_coefficients(smooth[0].join(smooth[1], ["roi_id", "frame"]).join(quiet, ["roi_id", "frame"]), tune)
