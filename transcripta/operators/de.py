"""Differential expression on long count tables.

Input shape everywhere: ``counts(gene, sample, value)`` (one row per cell)
and ``coldata(sample, grp)``.  Every statistic is an aggregate over a gene
or a sample key, so each operator is one or two shuffles on that key; the
sample-level tables (library sizes, factors) are S rows and are joined back
through AQE's runtime broadcast.  Scalars (median library size, variance
prior) are the only values brought to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transcripta.functions.columns import with_key_stats
from transcripta.functions.ranking import global_row_number, keyed_quantile, keyed_trim
from transcripta.functions.special import digamma, trigamma, trigamma_inverse
from transcripta.functions.stats import (
    bh_adjust, normal_two_sided_p, t_two_sided_p,
)
from transcripta.session import cut_lineage


def _with_grp(df: DataFrame, coldata: DataFrame | None, sample: str, grp: str) -> DataFrame:
    """Attach the group label unless the long table already carries it."""
    if grp in df.columns:
        return df
    return df.join(coldata.select(sample, grp), sample)


# ---------------------------------------------------------------------------
# Filters and library sizes
# ---------------------------------------------------------------------------

def de_row_filter(counts: DataFrame, min_total: float = 10, gene: str = "gene",
                  value: str = "value") -> DataFrame:
    """Keep the rows of genes whose total count is >= ``min_total``.

    Per-gene totals (map-side combined) select the genes; a semi join keeps
    their rows (broadcast: one row per gene, or AQE skew-split).
    """
    keep = counts.groupBy(gene).agg(F.sum(value).alias("_tot")).filter(F.col("_tot") >= min_total)
    return counts.join(keep.select(gene), gene, "left_semi")


def de_lib_size(counts: DataFrame, sample: str = "sample", value: str = "value") -> DataFrame:
    """Library size per sample: ``(sample, lib_size)``; recompute after filters."""
    return counts.groupBy(sample).agg(F.sum(F.col(value).cast("double")).alias("lib_size"))


def de_filter_by_expr(counts: DataFrame, min_count: float = 10.0, min_total_count: float = 15.0,
                      large_n: int = 10, min_prop: float = 0.7, gene: str = "gene",
                      sample: str = "sample", value: str = "value") -> DataFrame:
    """Expression filter without a design: the minimum group is all samples.

    cutoff = min_count / median(lib) * 1e6 (CPM); keep genes with CPM >=
    cutoff in at least h samples (h = n, or large_n + (n - large_n) *
    min_prop above large_n) and total count >= min_total_count.
    """
    lib = de_lib_size(counts, sample, value)
    stats = lib.agg(F.count(F.lit(1)).alias("n"), F.median("lib_size").alias("med")).first()
    n, med = int(stats["n"]), float(stats["med"])
    h = float(n) if n <= large_n else large_n + (n - large_n) * min_prop
    cutoff = min_count / med * 1e6
    tol = 1e-14
    j = counts.join(lib, sample)
    cpm = F.col(value) / F.col("lib_size") * 1e6
    keep = (j.groupBy(gene).agg(F.sum(F.when(cpm >= cutoff, 1).otherwise(0)).alias("_n_ok"),
                                F.sum(value).alias("_tot"))
            .filter((F.col("_n_ok") >= h - tol) & (F.col("_tot") >= min_total_count - tol)))
    return counts.join(keep.select(gene), gene, "left_semi")


# ---------------------------------------------------------------------------
# Normalisation factors
# ---------------------------------------------------------------------------

def de_size_factors(counts: DataFrame, gene: str = "gene", sample: str = "sample",
                    value: str = "value") -> DataFrame:
    """Median-of-ratios size factors ``(sample, size_factor)``.

    Genes with a zero in any sample have an infinite log geometric mean and
    are skipped; factor = exp(median_g(ln x_gs - mean_s ln x_gs)), the exact
    median by slices of the ratios.
    """
    lx = F.log(F.col(value).cast("double"))
    ratios = (with_key_stats(counts, gene, F.min(F.col(value)).alias("_nz"), F.avg(lx).alias("_lgm"))
              .filter(F.col("_nz") > 0)
              .withColumn("_r", lx - F.col("_lgm")))
    return keyed_quantile(ratios.select(sample, "_r"), sample, "_r", 0.5).select(sample, F.exp("q").alias("size_factor"))


def de_normalised_counts(counts: DataFrame, size_factors: DataFrame, sample: str = "sample",
                         value: str = "value") -> DataFrame:
    return (counts.join(size_factors, sample)
            .withColumn("norm_value", F.col(value) / F.col("size_factor"))
            .drop("size_factor"))


def de_tmm(counts: DataFrame, gene: str = "gene", sample: str = "sample", value: str = "value",
           logratio_trim: float = 0.3, sum_trim: float = 0.05,
           a_cutoff: float = -1e10) -> DataFrame:
    """TMM normalisation factors ``(sample, norm_factor)`` (Robinson & Oshlack 2010).

    Reference sample: upper quartile of x/lib closest to the mean upper
    quartile (first by sample name on ties).  Per sample: M = log2 ratio to
    the reference, A = mean log2 level, trimmed by average ranks (30 % of M,
    5 % of A), precision-weighted mean of M; factors rescaled to product 1.
    Quartiles and ranks go by slices of the values, so no task holds a sample.
    """
    lib = de_lib_size(counts, sample, value)
    j = counts.join(lib, sample)
    uq = keyed_quantile(j.select(sample, (F.col(value) / F.col("lib_size")).alias("_x")), sample, "_x", 0.75, "uq")
    w_all = Window.partitionBy()
    ref_row = (uq.withColumn("_d", F.abs(F.col("uq") - F.avg("uq").over(w_all)))
               .orderBy("_d", sample).select(sample).first())
    ref = ref_row[0]
    refc = (j.filter(F.col(sample) == F.lit(ref))
            .select(F.col(gene), F.col(value).alias("_ref"), F.col("lib_size").alias("_nr")))
    x = j.join(refc, gene)
    obs, nO = F.col(value).cast("double"), F.col("lib_size")
    rf, nR = F.col("_ref").cast("double"), F.col("_nr")
    x = (x.filter((obs > 0) & (rf > 0))
         .withColumn("_M", F.log2((obs / nO) / (rf / nR)))
         .withColumn("_A", (F.log2(obs / nO) + F.log2(rf / nR)) / 2)
         .withColumn("_v", (nO - obs) / nO / obs + (nR - rf) / nR / rf)
         .filter(F.col("_A") > a_cutoff))
    # written once: the ranks of M and of A, and the trimmed sums; ranks become bounds, one row per sample
    x = cut_lineage(x.select(sample, "_M", "_A", "_v"), "tmm-ratios")
    boundsM = keyed_trim(x, sample, "_M", logratio_trim).select(sample, F.col("lo").alias("_loM"), F.col("hi").alias("_hiM"))
    boundsA = keyed_trim(x, sample, "_A", sum_trim).select(sample, F.col("lo").alias("_loA"), F.col("hi").alias("_hiA"))
    x = x.join(boundsM.join(boundsA, sample, "full"), sample, "left")
    keep = F.col("_M").between(F.col("_loM"), F.col("_hiM")) & F.col("_A").between(F.col("_loA"), F.col("_hiA"))
    per = (x.groupBy(sample).agg(
        F.sum(F.when(keep, F.col("_M") / F.col("_v"))).alias("_num"),
        F.sum(F.when(keep, 1.0 / F.col("_v"))).alias("_den"),
        F.max(F.abs("_M")).alias("_maxM")))
    f = F.when(F.col("_maxM") < 1e-6, F.lit(1.0)).otherwise(
        F.pow(F.lit(2.0), F.coalesce(F.col("_num") / F.col("_den"), F.lit(0.0))))
    # samples with no usable gene keep factor 1
    per = lib.select(sample).join(per.select(sample, f.alias("_f")), sample, "left").select(
        sample, F.coalesce(F.col("_f"), F.lit(1.0)).alias("_f"))
    return per.select(sample, (F.col("_f") / F.exp(F.avg(F.log("_f")).over(w_all))).alias("norm_factor"))


def de_cpm(counts: DataFrame, lib: DataFrame | None = None, norm: DataFrame | None = None,
           log: bool = False, prior_count: float = 2.0, gene: str = "gene", sample: str = "sample",
           value: str = "value") -> DataFrame:
    """Counts per million, ``cpm`` column added.

    Effective library = lib_size * norm_factor.  With ``log``, the prior is
    scaled by library size (prior * L / mean L), the library enlarged by
    twice that prior, and log2 taken.
    """
    if lib is None:
        lib = de_lib_size(counts, sample, value)
    if norm is not None:
        lib = lib.join(norm, sample, "left").withColumn(
            "lib_size", F.col("lib_size") * F.coalesce(F.col("norm_factor"), F.lit(1.0))).drop("norm_factor")
    x = F.col(value).cast("double")
    L = F.col("lib_size")
    if log:
        lib = lib.withColumn("_ps", F.lit(prior_count) * L / F.avg(L).over(Window.partitionBy()))
        j = counts.join(lib, sample)
        cpm = F.log2((x + F.col("_ps")) / (L + 2 * F.col("_ps")) * 1e6)
        return j.withColumn("cpm", cpm).drop("lib_size", "_ps")
    return counts.join(lib, sample).withColumn("cpm", x / L * 1e6).drop("lib_size")


# ---------------------------------------------------------------------------
# voom
# ---------------------------------------------------------------------------

def de_voom(counts: DataFrame, coldata: DataFrame, norm: DataFrame | None = None,
            n_bins: int = 20, gene: str = "gene", sample: str = "sample", value: str = "value",
            grp: str = "grp") -> DataFrame:
    """log-CPM and precision weights ``(gene, sample, grp, logcpm, weight)``.

    logCPM = log2((x + 0.5) / (L + 1) * 1e6).  The mean-variance trend is a
    binned trend (re-aim of lowess): genes are cut into ``n_bins`` quantile
    bins of mean log count (exact, by distributed ranks), each bin
    contributes (median x, median sqrt-sd) as a knot, and the trend is the
    piecewise-linear interpolation between knots, constant outside.
    Weight = trend(fitted log count)^-4.
    """
    lib = de_lib_size(counts, sample, value)
    if norm is not None:
        lib = lib.join(norm, sample).withColumn(
            "lib_size", F.col("lib_size") * F.col("norm_factor")).drop("norm_factor")
    lib = cut_lineage(lib, "lib_sizes")  # one row per sample, read three times
    j = counts.join(lib, sample)
    if grp not in counts.columns:
        j = j.join(coldata.select(sample, grp), sample)
    j = j.withColumn("logcpm", F.log2((F.col(value) + 0.5) / (F.col("lib_size") + 1) * 1e6))
    # group-mean fit per gene: fitted value = mean logcpm of the gene's group;
    # residual SS from per-(gene, group) sums, all as map-side aggregates
    y = F.col("logcpm")
    gg = (j.groupBy(gene, grp).agg(F.avg(y).alias("_fit"), F.count(F.lit(1)).alias("_ng"),
                                   F.var_pop(y).alias("_v"), F.sum(y).alias("_s")))
    genes = (gg.groupBy(gene).agg(
        F.sum("_ng").alias("_n"), F.count(F.lit(1)).alias("_k"),
        F.sum(F.col("_v") * F.col("_ng")).alias("_rss"),
        (F.sum("_s") / F.sum("_ng")).alias("_amean")))
    j = j.join(gg.select(gene, grp, "_fit"), [gene, grp])
    mean_log_lib = lib.agg(F.avg(F.log2(F.col("lib_size") + 1))).first()[0]
    genes = cut_lineage(genes
                        .withColumn("sx", F.col("_amean") + F.lit(mean_log_lib - math.log2(1e6)))
                        .withColumn("sy", F.sqrt(F.sqrt(F.try_divide(F.col("_rss"), F.col("_n") - F.col("_k")))))
                        .select(gene, "sx", "sy"), "voom_gene_stats")  # one row per gene
    if genes.filter(F.col("sy").isNotNull()).limit(1).count() == 0:
        raise ValueError("voom needs a gene with more cells than groups")
    probs = [i / n_bins for i in range(1, n_bins)]
    # exact quantiles by distributed ranks: the value of rank ceil(prob * n), one row per bin edge
    n_genes = genes.count()
    ranked, _ = global_row_number(genes.select("sx", gene), ["sx", gene], "rn")
    edges = [r["sx"] for r in ranked.filter(F.col("rn").isin([max(1, math.ceil(p * n_genes)) for p in probs]))
             .orderBy("rn").collect()]
    bin_col = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        bin_col = F.when(F.col("sx") <= F.lit(edges[i]), F.lit(i)).otherwise(bin_col)
    knots = (genes.withColumn("_bin", bin_col).groupBy("_bin")
             .agg(F.median("sx").alias("kx"), F.median("sy").alias("ky"))
             .filter(F.col("ky").isNotNull()).orderBy("kx").collect())
    kx = [float(r["kx"]) for r in knots]
    ky = [float(r["ky"]) for r in knots]
    fitted_log_count = F.log2(F.pow(F.lit(2.0), F.col("_fit")) * 1e-6 * (F.col("lib_size") + 1))
    trend = _interp(fitted_log_count, kx, ky)
    return j.select(gene, sample, grp, "logcpm", F.pow(trend, -4).alias("weight"))


def _interp(x: Column, kx: list[float], ky: list[float]) -> Column:
    """Piecewise-linear interpolation through (kx, ky), constant outside."""
    if len(kx) == 1:
        return F.lit(ky[0])
    out = F.lit(ky[-1])
    for i in reversed(range(len(kx) - 1)):
        x0, x1, y0, y1 = kx[i], kx[i + 1], ky[i], ky[i + 1]
        seg = F.lit(y0) if x1 == x0 else F.lit(y0) + (x - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))
        out = F.when(x <= F.lit(x1), seg).otherwise(out)
    return F.when(x <= F.lit(kx[0]), F.lit(ky[0])).otherwise(out)


# ---------------------------------------------------------------------------
# Linear model, t statistics
# ---------------------------------------------------------------------------

def de_linear_fit(expr: DataFrame, coldata: DataFrame, case: str = "case", control: str = "control",
                  weight: str | None = None, gene: str = "gene", sample: str = "sample",
                  value: str = "value", grp: str = "grp") -> DataFrame:
    """Per-gene (weighted) least squares of ``value ~ group``.

    Closed form from one ``groupBy(gene)`` of conditional sums; residuals are
    taken about the group means (with weights by a second pass over the cells),
    never as a difference of large sums.  Returns
    ``gene, logFC (case - control), intercept, sigma2, df, stdev_unscaled,
    AveExpr``.
    """
    cols = [gene, sample, value] + ([weight] if weight and weight in expr.columns else [])
    if grp in expr.columns:
        j = expr.select(*cols, grp)
    else:
        j = expr.select(*cols).join(coldata.select(sample, grp), sample)
    y = F.col(value).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)

    def s(cond: Column, e: Column) -> Column:
        return F.sum(F.when(cond, e))

    is1, is0 = F.col(grp) == case, F.col(grp) == control
    j = j.filter(is1 | is0)
    spread = [] if weight else [(s(is1, F.lit(1)) * F.var_pop(F.when(is1, y)) + s(is0, F.lit(1)) * F.var_pop(F.when(is0, y)))
                                .alias("rss")]
    agg = j.groupBy(gene).agg(
        s(is1, w).alias("W1"), s(is0, w).alias("W0"),
        s(is1, w * y).alias("Y1"), s(is0, w * y).alias("Y0"),
        F.sum(F.lit(1)).alias("n"), F.avg(y).alias("AveExpr"), *spread)
    m1 = F.try_divide(F.col("Y1"), F.col("W1"))
    m0 = F.try_divide(F.col("Y0"), F.col("W0"))
    if weight:
        means = j.groupBy(gene, grp).agg(F.try_divide(F.sum(w * y), F.sum(w)).alias("_m"))
        about = j.join(means, [gene, grp]).groupBy(gene).agg(F.sum(w * F.pow(y - F.col("_m"), 2)).alias("rss"))
        agg = agg.join(about, gene)
    rss = F.col("rss")
    dfr = F.col("n") - 2
    return agg.select(
        gene, (m1 - m0).alias("logFC"), m0.alias("intercept"),
        F.when(dfr > 0, F.greatest(rss, F.lit(0.0)) / dfr).alias("sigma2"),
        dfr.cast("double").alias("df"),
        F.sqrt(F.try_divide(F.lit(1.0), F.col("W1")) + F.try_divide(F.lit(1.0), F.col("W0"))).alias("stdev_unscaled"),
        "AveExpr")


def de_welch_or_pooled_t(expr: DataFrame, coldata: DataFrame, case: str = "case",
                         control: str = "control", welch: bool = False, gene: str = "gene",
                         sample: str = "sample", value: str = "value", grp: str = "grp") -> DataFrame:
    """Plain two-group t test per gene ``(gene, logFC, AveExpr, t, df, PValue)``.

    Pooled variance by default (df = n1 + n0 - 2); Welch with ``welch=True``.
    A gene whose statistic is undefined (no spread, one cell in a group) gets
    a null t and p.
    """
    j = _with_grp(expr, coldata, sample, grp)
    y = F.col(value).cast("double")
    is1, is0 = F.col(grp) == case, F.col(grp) == control
    agg = j.filter(is1 | is0).groupBy(gene).agg(
        F.avg(F.when(is1, y)).alias("m1"), F.avg(F.when(is0, y)).alias("m0"),
        F.var_samp(F.when(is1, y)).alias("v1"), F.var_samp(F.when(is0, y)).alias("v0"),
        F.count(F.when(is1, y)).alias("n1"), F.count(F.when(is0, y)).alias("n0"),
        F.avg(y).alias("AveExpr"))
    d = F.col("m1") - F.col("m0")
    n1, n0, v1, v0 = F.col("n1"), F.col("n0"), F.col("v1"), F.col("v0")
    if welch:
        se2 = F.try_divide(v1, n1) + F.try_divide(v0, n0)
        dfc = F.try_divide(F.pow(se2, 2), F.try_divide(F.pow(v1 / n1, 2), n1 - 1) + F.try_divide(F.pow(v0 / n0, 2), n0 - 1))
    else:
        sp2 = F.try_divide((n1 - 1) * v1 + (n0 - 1) * v0, n1 + n0 - 2)
        se2 = sp2 * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0))
        dfc = (n1 + n0 - 2).cast("double")
    t = F.when(se2 > 0, d / F.sqrt(se2))
    out = agg.select(gene, d.alias("logFC"), "AveExpr", t.alias("t"), dfc.alias("df"))
    return out.withColumn("PValue", t_two_sided_p(F.col("t"), F.col("df")))


def de_moderated_t(fit: DataFrame, gene: str = "gene") -> DataFrame:
    """Empirical-Bayes moderated t (Smyth 2004) on a ``de_linear_fit`` result.

    Prior (d0, s0^2) from the moments of e = ln s^2 - digamma(d/2) + ln(d/2);
    posterior s~^2 = (d0 s0^2 + d s^2)/(d0 + d); t = logFC/(stdev_unscaled*s~);
    df_total = min(d + d0, sum of residual df).  Only a per-df summary (a few
    rows) reaches the driver.
    """
    ok = fit.filter(F.col("sigma2") > 0)
    by_df = (ok.groupBy("df").agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(F.log("sigma2")).alias("s1"),
                                  F.sum(F.pow(F.log("sigma2"), 2)).alias("s2")).collect())
    n = sum(int(r["n"]) for r in by_df)
    if n < 2:
        raise ValueError("moderated t needs at least two genes with positive variance")
    # e_g = z_g - c(df_g); combine group sums into mean / variance of e
    sum_e = sum(r["s1"] - r["n"] * (digamma(r["df"] / 2) - math.log(r["df"] / 2)) for r in by_df)
    emean = sum_e / n
    sum_e2 = 0.0
    for r in by_df:
        c = digamma(r["df"] / 2) - math.log(r["df"] / 2)
        # sum (z - c - emean)^2 = s2 - 2 (c+emean) s1 + n (c+emean)^2
        k = c + emean
        sum_e2 += r["s2"] - 2 * k * r["s1"] + r["n"] * k * k
    evar = sum_e2 / (n - 1) - sum(r["n"] * trigamma(r["df"] / 2) for r in by_df) / n
    total_df = sum(r["n"] * r["df"] for r in by_df)
    if evar > 0:
        d0 = 2 * trigamma_inverse(evar)
        s02 = math.exp(emean + digamma(d0 / 2) - math.log(d0 / 2))
        post = (F.lit(d0 * s02) + F.col("df") * F.col("sigma2")) / (F.lit(d0) + F.col("df"))
        df_tot = F.least(F.col("df") + F.lit(d0), F.lit(float(total_df)))
    else:
        d0, s02 = math.inf, math.exp(emean)
        post = F.lit(s02)
        df_tot = F.lit(float(total_df))
    t = F.col("logFC") / (F.col("stdev_unscaled") * F.sqrt(post))
    out = fit.select("*", post.alias("s2_post"), t.alias("t"), df_tot.alias("df_total"),
                     F.lit(d0).alias("df_prior"), F.lit(s02).alias("s2_prior"))
    return out.withColumn("PValue", t_two_sided_p(F.col("t"), F.col("df_total")))


def de_nb_two_group(counts: DataFrame, coldata: DataFrame, size_factors: DataFrame,
                    case: str = "case", control: str = "control", gene: str = "gene",
                    sample: str = "sample", value: str = "value", grp: str = "grp") -> DataFrame:
    """Two-group negative-binomial Wald-type test with moment dispersion.

    q = x / s (size factor).  Per group g: mean mu_g, variance v_g of q, and
    z_g = mean(1/s).  Dispersion a = max(0, mean_g((v_g - mu_g z_g)/mu_g^2)).
    logFC = log2(mu_1/mu_0); SE = sqrt(sum_g (z_g/mu_g + a)/n_g)/ln 2;
    z = logFC/SE, p two-sided normal.  (Re-aim of per-gene GLM solvers.)
    """
    j = _with_grp(counts.join(size_factors, sample), coldata, sample, grp)
    j = (j.withColumn("_q", F.col(value) / F.col("size_factor"))
         .withColumn("_is", 1.0 / F.col("size_factor")))
    is1, is0 = F.col(grp) == case, F.col(grp) == control
    agg = j.filter(is1 | is0).groupBy(gene).agg(
        F.avg(F.when(is1, F.col("_q"))).alias("mu1"), F.avg(F.when(is0, F.col("_q"))).alias("mu0"),
        F.var_samp(F.when(is1, F.col("_q"))).alias("v1"), F.var_samp(F.when(is0, F.col("_q"))).alias("v0"),
        F.avg(F.when(is1, F.col("_is"))).alias("z1"), F.avg(F.when(is0, F.col("_is"))).alias("z0"),
        F.count(F.when(is1, 1)).alias("n1"), F.count(F.when(is0, 1)).alias("n0"),
        F.avg("_q").alias("baseMean"))
    mu1, mu0 = F.col("mu1"), F.col("mu0")
    a = F.greatest(F.lit(0.0), ((F.col("v1") - mu1 * F.col("z1")) / (mu1 * mu1)
                                + (F.col("v0") - mu0 * F.col("z0")) / (mu0 * mu0)) / 2)
    ok = (mu1 > 0) & (mu0 > 0)
    lfc = F.when(ok, F.log2(mu1 / mu0))
    se = F.when(ok, F.sqrt((F.col("z1") / mu1 + F.col("dispersion")) / F.col("n1")
                           + (F.col("z0") / mu0 + F.col("dispersion")) / F.col("n0")) / math.log(2))
    out = (agg.withColumn("dispersion", F.when(ok, a))
           .select(gene, "baseMean", "dispersion", lfc.alias("logFC"), se.alias("lfcSE")))
    out = out.withColumn("stat", F.col("logFC") / F.col("lfcSE"))
    return out.withColumn("PValue", normal_two_sided_p(F.col("stat")))


# ---------------------------------------------------------------------------
# Adjustment, tables, decisions
# ---------------------------------------------------------------------------

def de_bh_adjust(res: DataFrame, p_col: str = "PValue", gene: str = "gene",
                 out_col: str = "FDR", partition_cols: tuple = (), distributed: bool = True) -> DataFrame:
    """BH per test family; ``distributed`` for one very large family."""
    return bh_adjust(res, p_col, gene, out_col, partition_cols, distributed)


def de_top_table(res: DataFrame, p_col: str = "PValue", gene: str = "gene",
                 columns: tuple = ("logFC", "AveExpr", "t", "PValue", "FDR")) -> DataFrame:
    """All genes ordered by p (then gene) with the usual statistics."""
    if "FDR" not in res.columns:
        res = bh_adjust(res, p_col, gene)
    keep = [gene] + [c for c in columns if c in res.columns]
    return res.select(*keep).orderBy(F.col(p_col).asc_nulls_last(), F.col(gene))


def de_decide(res: DataFrame, p_cut: float = 0.05, lfc_cut: float = 1.0, p_col: str = "FDR",
              lfc_col: str = "logFC") -> DataFrame:
    """-1 / 0 / +1: p < p_cut and |logFC| >= lfc_cut, sign of logFC."""
    sig = (F.col(p_col) < p_cut) & (F.abs(F.col(lfc_col)) >= lfc_cut)
    return res.withColumn("decision", F.when(sig, F.signum(F.col(lfc_col)).cast("int"))
                          .otherwise(F.lit(0)))


def de_up_down_summary(decided: DataFrame) -> DataFrame:
    """Counts of Down / NotSig / Up (all three rows present)."""
    labels = F.when(F.col("decision") < 0, "Down").when(F.col("decision") > 0, "Up").otherwise("NotSig")
    got = decided.groupBy(labels.alias("direction")).agg(F.count(F.lit(1)).alias("n_genes"))
    spark = decided.sparkSession
    allrows = spark.createDataFrame([("Down",), ("NotSig",), ("Up",)], "direction string")
    return (allrows.join(got, "direction", "left")
            .select("direction", F.coalesce(F.col("n_genes"), F.lit(0).cast("bigint")).alias("n_genes")))


def deg_select(deg: DataFrame, p_cut: float = 0.05, lfc_cut: float = 1.0, p_col: str = "PValue",
               lfc_col: str = "logFC") -> DataFrame:
    """Strict selection: up = p < cut and logFC > cut; down = p < cut and logFC < -cut."""
    p, l = F.col(p_col), F.col(lfc_col)
    direction = F.when((p < p_cut) & (l > lfc_cut), "up").when((p < p_cut) & (l < -lfc_cut), "down")
    return deg.withColumn("direction", direction).filter(F.col("direction").isNotNull())


def volcano_classify(deg: DataFrame, lfc_cut: float = 1.0, p_cut: float = 0.05,
                     p_col: str = "PValue", lfc_col: str = "logFC",
                     highlight: DataFrame | None = None, gene: str = "GeneSymbol") -> DataFrame:
    """Inclusive colouring: red (up), blue (down), grey; highlighted genes
    orange.  ``neg_log10_p`` is null for p = 0 or missing p."""
    p, l = F.col(p_col), F.col(lfc_col)
    colour = (F.when((l >= lfc_cut) & (p <= p_cut), "red")
              .when((l <= -lfc_cut) & (p <= p_cut), "blue").otherwise("grey"))
    out = deg.withColumn("colour", colour).withColumn(
        "neg_log10_p", F.when(p > 0, -F.log10(p)))
    if highlight is not None:
        hl = highlight.select(F.col(highlight.columns[0]).alias(gene)).distinct().withColumn("_hl", F.lit(True))
        out = (out.join(hl, gene, "left")
               .withColumn("colour", F.when(F.col("_hl"), F.lit("orange")).otherwise(F.col("colour")))
               .drop("_hl"))
    return out


def volcano_top_labels(deg: DataFrame, n: int = 20, p_col: str = "PValue",
                       gene: str = "GeneSymbol") -> DataFrame:
    """The n smallest p-values (ties by gene); n = 0 gives no rows.  A top-k:
    Spark plans it as TakeOrderedAndProject (per-partition top-n, no sort)."""
    return deg.filter(F.col(p_col).isNotNull()).orderBy(F.col(p_col), F.col(gene)).limit(max(n, 0))
