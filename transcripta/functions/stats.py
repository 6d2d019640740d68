"""Distribution functions and multiple-testing adjustment.

Spark has no lgamma, erf or incomplete beta.  Where a closed form exists it
is written as a Column expression (stays inside whole-stage codegen);
otherwise an Arrow-batched pandas UDF evaluates a vectorised numpy routine.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transcripta.session import ship_package


# ---------------------------------------------------------------------------
# Student t
# ---------------------------------------------------------------------------

def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, most: int = 1_000_000) -> np.ndarray:
    """Continued fraction of the incomplete beta (modified Lentz).

    Each element is iterated until it no longer changes; one that has not
    settled after ``most`` steps raises.
    """
    tiny = 1e-300
    out = np.empty_like(x)
    todo = np.arange(len(x))
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, most):
        if not len(todo):
            return out
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        done = np.abs(d * c - 1.0) < 1e-15
        if done.any():
            out[todo[done]] = h[done]
            left = ~done
            todo, a, b, x, c, d, h = (v[left] for v in (todo, a, b, x, c, d, h))
    raise ArithmeticError("incomplete beta did not converge")


def _log_gamma_half(a: np.ndarray) -> np.ndarray:
    """ln(gamma(a + 1/2) / gamma(a)): the asymptotic series of the ratio at
    a + 20, and the recurrence down from there (no difference of large logs)."""
    z = a + 20.0
    r = 1.0 / z
    out = 0.5 * np.log(z) - r / 8 + r**3 / 192 - r**5 / 640 + 17 * r**7 / 14336 - 31 * r**9 / 18432
    for k in range(20):
        out += np.log1p(-0.5 / (a + k + 0.5))
    return out


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student t, as I_x(df/2, 1/2) with x = df/(df + t^2).

    The small tail is computed directly, never as a difference from 1, so its
    relative error stays near 1e-13.  Infinite df is the normal limit; NaN in,
    or df <= 0, gives NaN.
    """
    t, df = np.abs(np.asarray(t, dtype=float)), np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    ok = ~np.isnan(t) & (df > 0)
    out[ok & (t == 0)] = 1.0
    out[ok & np.isinf(t)] = 0.0
    limit = ok & np.isinf(df) & (t > 0) & np.isfinite(t)
    out[limit] = [math.erfc(v / math.sqrt(2.0)) for v in t[limit]]
    mid = ok & np.isfinite(df) & (t > 0) & np.isfinite(t)
    if mid.any():
        q, a = t[mid] / np.sqrt(df[mid]), df[mid] / 2
        far = q > 1.0  # x and 1 - x, each without cancellation
        inv = 1.0 / np.where(far, q, 1.0)
        x = np.where(far, inv * inv / (1 + inv * inv), 1.0 / (1 + np.where(far, 0.0, q) ** 2))
        y = np.where(far, 1.0 / (1 + inv * inv), np.where(far, 0.0, q) ** 2 * x)
        log_x = np.where(far, 2 * np.log(inv) - np.log1p(inv * inv), -np.log1p(np.where(far, 0.0, q) ** 2))
        front = np.exp(_log_gamma_half(a) - 0.5 * math.log(math.pi) + a * log_x + 0.5 * np.log(y))
        half = np.full_like(a, 0.5)
        low = x < (a + 1.0) / (a + 2.5)
        p = np.empty_like(a)
        p[low] = front[low] * _beta_fraction(a[low], half[low], x[low]) / a[low]
        p[~low] = 1.0 - front[~low] * _beta_fraction(half[~low], a[~low], y[~low]) / 0.5
        out[mid] = np.clip(p, 0.0, 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def _t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    p = t_tail(t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan))
    return pd.Series(p).astype("Float64").where(~np.isnan(p), pd.NA)


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student t for any positive df (one row per gene or test:
    an Arrow-batched pandas UDF).  Null t or df gives null."""
    ship_package(SparkSession.active())
    return _t_p_udf(t.cast("double"), df.cast("double"))


# ---------------------------------------------------------------------------
# Normal
# ---------------------------------------------------------------------------

def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of an array of non-negative numbers: a series of positive terms, or a continued fraction."""
    near = np.minimum(x, 2.5)
    term = total = near
    for n in range(1, 70):
        term = term * (2 * near * near / (2 * n + 1))
        total = total + term
    series = 1 - 2 / math.sqrt(math.pi) * np.exp(-near * near) * total
    far, tail = np.maximum(x, 2.5), np.zeros(np.shape(x))
    for k in range(70, 0, -1):
        tail = k / 2 / (far + tail)
    return np.where(x < 2.5, series, np.exp(-far * far) / math.sqrt(math.pi) / (far + tail))


@F.pandas_udf(T.DoubleType())
def _norm_p_udf(z: pd.Series) -> pd.Series:
    zz = z.to_numpy(dtype=float, na_value=np.nan)
    out = np.full(zz.shape, np.nan)
    ok = ~np.isnan(zz)
    out[ok] = _erfc(np.abs(zz[ok]) / math.sqrt(2.0))
    return pd.Series(out)


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided normal tail 2*(1 - Phi(|z|)) = erfc(|z|/sqrt 2)."""
    ship_package(SparkSession.active())
    return _norm_p_udf(z.cast("double"))


# ---------------------------------------------------------------------------
# Log factorial (for hypergeometric terms)
# ---------------------------------------------------------------------------

def log_factorial(n: Column) -> Column:
    """ln(n!) as a pure Column expression.

    Exact ``ln(factorial(n))`` for n <= 20 (Spark's ``factorial`` covers
    0..20); Stirling series with four correction terms above, whose error is
    below 1e-15 relative for n > 20.
    """
    x = n.cast("double")
    stirling = (x * F.log(x) - x + F.lit(0.5) * F.log(F.lit(2.0 * math.pi) * x)
                + F.lit(1.0 / 12.0) / x
                - F.lit(1.0 / 360.0) / F.pow(x, 3)
                + F.lit(1.0 / 1260.0) / F.pow(x, 5)
                - F.lit(1.0 / 1680.0) / F.pow(x, 7))
    return (F.when(n.isNull(), None)
            .when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double")))
            .otherwise(stirling))


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


# ---------------------------------------------------------------------------
# Benjamini-Hochberg
# ---------------------------------------------------------------------------

def bh_adjust(df: DataFrame, p_col: str, order_col: str, out_col: str = "FDR",
              partition_cols: list[str] | tuple = (), distributed: bool = True) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values.

    ``row_number`` over (p, order_col) -- not ``rank`` -- then the running
    minimum of p*m/i from the largest p down, capped at 1.  Null p-values are
    not tests: they get a null FDR and do not count in m.

    Scale: the windows are partitioned by ``partition_cols`` (one contrast,
    panel or ontology per partition); m is the number of genes or terms of
    one test family, which is bounded by the annotation, not by the data.
    One family over the whole table (no partition columns) is adjusted by
    slices of p instead of a one-task window (``functions.ranking.bh_distributed``)
    unless ``distributed=False``.
    """
    if distributed and not partition_cols:
        from transcripta.functions.ranking import bh_distributed
        return bh_distributed(df, p_col, out_col)
    parts = [F.col(c) for c in partition_cols]
    p = F.col(p_col)
    up = Window.partitionBy(*parts).orderBy(p.asc_nulls_last(), F.col(order_col))
    down = (Window.partitionBy(*parts).orderBy(p.desc_nulls_first(), F.col(order_col).desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # untested rows come last in rank and first from the top, with a null that min() passes over
    ranked = (df.withColumn("_bh_i", F.row_number().over(up))
              .withColumn("_bh_m", F.count(p).over(Window.partitionBy(*parts))))
    q = F.min(p * F.col("_bh_m") / F.col("_bh_i")).over(down)
    return (ranked.withColumn(out_col, F.when(p.isNotNull(), F.least(F.lit(1.0), q)))
            .drop("_bh_i", "_bh_m"))
