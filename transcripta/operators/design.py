"""Linear models for factors with any number of levels, covariates and contrasts.

Every gene's normal equations are one aggregate over its cells (products of
the design's columns, a handful per cell); the Cholesky factor and the forward
substitutions are Column expressions on one row per gene.  Residuals are taken
in a second pass about the fitted values, never as a difference of large sums.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transcripta.functions.ranking import global_row_number
from transcripta.functions.stats import bh_adjust, t_tail
from transcripta.operators.de import _with_grp, de_moderated_t
from transcripta.session import cut_lineage

#: a pivot below this share of its column's own square means that the column depends on those before it
RANK_TOLERANCE = 1e-10


def factor_levels(coldata: DataFrame, factor: str = "grp") -> list:
    """The levels of a factor in sorted order, as many as the design has groups."""
    return [r[0] for r in coldata.select(factor).filter(F.col(factor).isNotNull()).distinct().orderBy(factor).collect()]


def design_fit(expr: DataFrame, coldata: DataFrame | None = None, factor: str = "grp", levels: list | None = None,
               covariates: tuple = (), contrasts: dict | None = None, weight: str | None = None, gene: str = "gene",
               sample: str = "sample", value: str = "value") -> DataFrame:
    """Per-gene (weighted) least squares of ``value ~ factor + covariates``.

    ``levels``: the factor's levels, the reference first (sorted ones when not
    given); cells of other levels, without a value or a covariate are left out.
    The coefficients are the differences of each level from the reference, then
    the covariates.  ``contrasts`` names weighted sums of coefficients
    (``{"c - b": {"c": 1, "b": -1}}``, the reference weighs nothing); without
    them every coefficient is one.  Returns one row per gene and contrast:
    ``gene, coefficient, logFC, intercept, sigma2, df, stdev_unscaled, AveExpr``.
    A gene whose cells do not determine all coefficients has null estimates.
    """
    levels = levels if levels is not None else factor_levels(coldata if coldata is not None else expr, factor)
    if len(levels) < 2:
        raise ValueError("a design needs at least two levels")
    names = ["(Intercept)", *[str(x) for x in levels[1:]], *covariates]
    contrasts = contrasts if contrasts is not None else {n: {n: 1.0} for n in names[1:]}
    if unknown := {k for c in contrasts.values() for k in c} - {*names, str(levels[0])}:
        raise ValueError(f"unknown coefficients {sorted(unknown)}")
    extra = [c for c in covariates if c not in expr.columns]
    rows = _with_grp(expr, coldata, sample, factor)
    if extra:
        rows = rows.join(coldata.select(sample, *extra), sample)
    y, w = F.col(value).cast("double"), (F.col(weight).cast("double") if weight else F.lit(1.0))
    rows = rows.select(F.col(gene).alias("_g"), y.alias("_y"), w.alias("_w"), F.lit(1.0).alias("_x0"),
                       *[F.when(F.col(factor) == x, 1.0).otherwise(0.0).alias(f"_x{i}") for i, x in enumerate(levels[1:], 1)],
                       *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(covariates, len(levels))],
                       F.col(factor).isin(levels).alias("_in"))
    p = len(names)
    there = F.col("_in") & F.col("_y").isNotNull() & ~F.isnan("_y") & F.col("_w").isNotNull()
    for i in range(len(levels), p):
        there = there & F.col(f"_x{i}").isNotNull()
    rows = rows.filter(there)
    x = [F.col(f"_x{i}") for i in range(p)]
    each = rows.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("AveExpr"),
        *[F.sum(F.col("_w") * x[i] * x[j]).alias(f"_a{i}_{j}") for i in range(p) for j in range(i + 1)],
        *[F.sum(F.col("_w") * x[i] * F.col("_y")).alias(f"_b{i}") for i in range(p)])
    solved = cut_lineage(_solved(each, p, [[_weight(c, names, i) for i in range(p)] for c in contrasts.values()]), "design-fit")
    # residuals about the fitted values
    beta = solved.select("_g", *[f"_c{i}" for i in range(p)])
    fitted = sum((F.col(f"_x{i}") * F.col(f"_c{i}") for i in range(1, p)), F.col("_c0"))
    rss = rows.join(beta, "_g").groupBy("_g").agg(F.sum(F.col("_w") * F.pow(F.col("_y") - fitted, 2)).alias("_rss"))
    df = F.col("_n") - p
    out = solved.join(rss, "_g").select(
        "_g", "AveExpr", F.col("_c0").alias("intercept"), df.cast("double").alias("df"),
        F.when(df > 0, F.col("_rss") / df).alias("sigma2"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"_e{i}").alias("est"), F.col(f"_s{i}").alias("sd"))
                            for i, k in enumerate(contrasts)])).alias("_r"))
    return out.select(F.col("_g").alias(gene), F.col("_r.name").alias("coefficient"), F.col("_r.est").alias("logFC"), "intercept",
                      "sigma2", "df", F.col("_r.sd").alias("stdev_unscaled"), "AveExpr")


def _weight(contrast: dict, names: list[str], i: int) -> float:
    return float(contrast.get(names[i], 0.0))


def _solved(each: DataFrame, p: int, contrasts: list[list[float]]) -> DataFrame:
    """Adds the coefficients ``_c<i>``, and ``_e<k>`` and ``_s<k>`` of every contrast, step by step down the Cholesky factor."""

    def dot(a: str, b: str, n: int) -> Column:
        return sum((F.col(f"{a}{k}") * F.col(f"{b}{k}") for k in range(n)), F.lit(0.0))

    df = each
    for i in range(p):  # row i of the factor L, and of u in L u = b
        for j in range(i):
            left = F.col(f"_a{i}_{j}") - dot(f"_l{i}_", f"_l{j}_", j)
            df = df.withColumn(f"_l{i}_{j}", F.try_divide(left, F.col(f"_l{j}_{j}")))
        left = F.col(f"_a{i}_{i}") - dot(f"_l{i}_", f"_l{i}_", i)
        df = df.withColumn(f"_l{i}_{i}", F.when(left > RANK_TOLERANCE * F.col(f"_a{i}_{i}"), F.sqrt(left)))
        df = df.withColumn(f"_u{i}", (F.col(f"_b{i}") - dot(f"_l{i}_", "_u", i)) / F.col(f"_l{i}_{i}"))
    unit = [[1.0 if i == k else 0.0 for i in range(p)] for k in range(p)]
    for k, c in enumerate([*unit, *contrasts]):  # L z = c; the estimate is z . u, its unscaled variance z . z
        for i in range(p):
            df = df.withColumn(f"_z{k}_{i}", (F.lit(c[i]) - dot(f"_l{i}_", f"_z{k}_", i)) / F.col(f"_l{i}_{i}"))
    return df.select("_g", "_n", "AveExpr", *[dot(f"_z{k}_", "_u", p).alias(f"_c{k}") for k in range(p)],
                     *[dot(f"_z{p + k}_", "_u", p).alias(f"_e{k}") for k in range(len(contrasts))],
                     *[F.sqrt(dot(f"_z{p + k}_", f"_z{p + k}_", p)).alias(f"_s{k}") for k in range(len(contrasts))])


def t_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """t with two-sided tail p, by bisection on the logarithm of t."""
    p, df = np.asarray(p, float), np.asarray(df, float)
    lo, hi = np.full(p.shape, math.log(1e-12)), np.full(p.shape, math.log(1e150))
    for _ in range(200):
        mid = (lo + hi) / 2
        above = t_tail(np.exp(mid), df) > p
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.exp((lo + hi) / 2)


def prior_variance(moderated: DataFrame, proportion: float = 0.01, sd_limits: tuple = (0.1, 4.0), gene: str = "gene") -> float:
    """Variance of the true log fold changes of regulated genes, as a multiple of the genes' own unscaled variance.

    Smyth (2004): the largest ``proportion / 2`` of the |t| are set against the
    quantiles that a mixture of regulated and other genes would give; the
    variances they ask for are averaged within the limits.  The ranks are
    distributed; one number comes back.
    """
    rows = moderated.filter(F.col("t").isNotNull()).select(F.abs("t").alias("t"), "df_total", "stdev_unscaled", "s2_prior", F.col(gene).alias("g"))
    rows = cut_lineage(rows, "moderated-t")
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.max("df_total").alias("df"), F.first("s2_prior").alias("s02")).first()
    n = head["n"]
    if not n:
        return float("nan")
    take, df = math.ceil(proportion / 2 * n), head["df"]
    share = max(take / n, proportion)
    low, high = (x * x / head["s02"] for x in sd_limits)

    def asked(batches):
        for pdf in batches:
            t, sd, own = (pdf[c].to_numpy(float) for c in ("t", "stdev_unscaled", "df_total"))
            tail = t_tail(t, own)
            less = own < df
            if less.any():  # the t of the same tail at the common degrees of freedom
                t = np.where(less, t_quantile(tail, np.full(t.shape, df)), t)
            target = ((pdf["rn"].to_numpy(float) - 0.5) / n - (1 - share) * tail) / share
            v = np.zeros(len(t))
            more = target > tail
            if more.any():
                v[more] = sd[more] ** 2 * ((t[more] / t_quantile(target[more], np.full(int(more.sum()), df))) ** 2 - 1)
            yield pd.DataFrame({"v": np.clip(v, low, high)})

    ranked, _ = global_row_number(rows, [F.col("t").desc(), F.col("g")], "rn")
    return ranked.filter(F.col("rn") <= take).mapInPandas(asked, "v double").agg(F.avg("v")).first()[0]


def log_odds(moderated: DataFrame, proportion: float = 0.01, gene: str = "gene") -> DataFrame:
    """Adds ``B``, the log odds that a gene is regulated (Smyth 2004), to a moderated t table of one coefficient."""
    v0 = prior_variance(moderated, proportion, gene=gene)
    var = F.pow("stdev_unscaled", F.lit(2))
    r, t2, df = (var + F.lit(v0)) / var, F.pow("t", F.lit(2)), F.col("df_total")
    finite = (1 + df) / 2 * F.log((t2 + df) / (t2 / r + df))
    kernel = F.when(F.col("df_prior") > 1e6, t2 * (1 - 1 / r) / 2).otherwise(finite)
    return moderated.withColumn("B", F.lit(math.log(proportion / (1 - proportion))) - F.log(r) / 2 + kernel)


def coefficient_table(fit: DataFrame, coefficient: str, gene: str = "gene") -> DataFrame:
    """The top table of one coefficient or contrast: moderated t, p, FDR and B of every gene, without an order."""
    one = cut_lineage(de_moderated_t(fit.filter(F.col("coefficient") == coefficient), gene), "coefficient")
    return bh_adjust(log_odds(one, gene=gene), "PValue", gene, distributed=True).select(
        gene, "coefficient", "logFC", "AveExpr", "t", "PValue", "FDR", "B")
