"""Recursions over one symbol's rows that no built-in window expresses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ewm(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """Recursive exponential mean that starts at the first number; nulls before ``least`` numbers."""
    return pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=least).mean().to_numpy()


def expanding_percentile(x: np.ndarray, least: int, block: int = 512) -> np.ndarray:
    """(numbers so far that are at most the current one - 1) / (numbers so far - 1).

    A block at a time: against the sorted numbers before it, and within itself.
    """
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(~np.isnan(x))
    held = np.zeros(0)
    for a in range(0, len(at), block):
        v = x[at[a : a + block]]
        among = np.tril(v[None, :] <= v[:, None]).sum(axis=1)
        seen = a + 1 + np.arange(len(v))
        below = np.searchsorted(held, v, side="right") + among
        out[at[a : a + block]] = np.where(seen >= max(2, least), (below - 1) / np.maximum(seen - 1, 1), np.nan)
        held = np.sort(np.concatenate([held, v]), kind="stable")
    return out


def momentum_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    """RSI, MACD and ATR of one symbol, and the expanding percentile of its volatility."""
    pdf = pdf.sort_values("date")
    c = pdf["adj_close"].to_numpy(dtype=float)
    diff = np.diff(c, prepend=np.nan)
    gain = np.where(np.isnan(diff), np.nan, np.maximum(diff, 0))
    loss = np.where(np.isnan(diff), np.nan, np.maximum(-diff, 0))
    up, down = ewm(gain, 1 / 14, 14), ewm(loss, 1 / 14, 14)
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(down == 0, np.where(np.isnan(up), np.nan, 100.0), 100 - 100 / (1 + up / down))
    macd = ewm(c, 2 / 13, 12) - ewm(c, 2 / 27, 26)
    signal = ewm(macd, 2 / 10, 9)
    atr = ewm(pdf["_tr"].to_numpy(dtype=float), 1 / 14, 14)
    out = pdf.drop(columns="_tr").assign(rsi_14=rsi, macd=macd, macd_signal=signal, macd_hist=macd - signal, atr_pct_14=atr / np.where(c == 0, np.nan, c))
    return out.assign(vol_percentile_expanding=expanding_percentile(pdf["volatility_20"].to_numpy(dtype=float), 252))


KERNEL_COLUMNS = ["rsi_14", "macd", "macd_signal", "macd_hist", "atr_pct_14", "vol_percentile_expanding"]


def with_momentum(df: DataFrame) -> DataFrame:
    """df without ``_tr`` plus ``KERNEL_COLUMNS``. One symbol's rows meet in one task, as for its windows."""
    fields = [f for f in df.schema.fields if f.name != "_tr"] + [T.StructField(c, T.DoubleType()) for c in KERNEL_COLUMNS]
    out = df.groupBy("symbol").applyInPandas(momentum_kernel, T.StructType(fields))
    nulled = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in fields]
    return out.select(*nulled)
