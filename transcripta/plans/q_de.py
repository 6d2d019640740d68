"""Registered differential-expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from transcripta.operators import de
from transcripta.operators import design as dg
from transcripta.plans import fixtures as fx
from transcripta.plans.fixture_sql import bh_sql, t_p_even_sql
from transcripta.plans.registry import register


@register("de_row_filter", """
SELECT gene, sample, grp, value FROM counts
WHERE gene IN (SELECT gene FROM counts GROUP BY gene HAVING sum(value) >= 800)""", ("counts",))
def q_de_row_filter(spark, sf_dir):
    return de.de_row_filter(fx.counts(spark, sf_dir), min_total=800)


@register("de_lib_size", """
SELECT sample, CAST(sum(value) AS DOUBLE) AS lib_size FROM counts GROUP BY sample""",
          ("counts",), doubles=("lib_size",))
def q_de_lib_size(spark, sf_dir):
    return de.de_lib_size(fx.counts(spark, sf_dir))


# cutoff 10 counts at the median library; h = 10 + 2*0.7 = 11.4 of 12 samples
@register("de_filter_by_expr", """
WITH lib AS (SELECT sample, sum(value) AS L FROM counts GROUP BY sample),
par AS (SELECT 10.0 / median(L) * 1e6 AS cut FROM lib),
g AS (SELECT c.gene, sum(CASE WHEN c.value / lib.L * 1e6 >= par.cut THEN 1 ELSE 0 END) AS n_ok,
             sum(c.value) AS tot
      FROM counts c JOIN lib USING (sample), par GROUP BY c.gene)
SELECT gene, sample, grp, value FROM counts
WHERE gene IN (SELECT gene FROM g WHERE n_ok >= 11.4 - 1e-14 AND tot >= 15 - 1e-14)""", ("counts",))
def q_de_filter_by_expr(spark, sf_dir):
    return de.de_filter_by_expr(fx.counts(spark, sf_dir))


@register("de_size_factors", """
WITH nz AS (SELECT gene FROM counts GROUP BY gene HAVING min(value) > 0),
l AS (SELECT c.gene, c.sample, ln(c.value) AS lx FROM counts c JOIN nz USING (gene)),
r AS (SELECT sample, lx - avg(lx) OVER (PARTITION BY gene) AS r FROM l)
SELECT sample, exp(median(r)) AS size_factor FROM r GROUP BY sample""", ("counts",),
          doubles=("size_factor",))
def q_de_size_factors(spark, sf_dir):
    return de.de_size_factors(fx.counts(spark, sf_dir))


@register("de_normalised_counts", """
WITH nz AS (SELECT gene FROM counts GROUP BY gene HAVING min(value) > 0),
l AS (SELECT c.gene, c.sample, ln(c.value) AS lx FROM counts c JOIN nz USING (gene)),
r AS (SELECT sample, lx - avg(lx) OVER (PARTITION BY gene) AS r FROM l),
sf AS (SELECT sample, exp(median(r)) AS size_factor FROM r GROUP BY sample)
SELECT gene, sample, grp, value, value / size_factor AS norm_value FROM counts JOIN sf USING (sample)""",
          ("counts",), doubles=("norm_value",))
def q_de_normalised_counts(spark, sf_dir):
    c = fx.counts(spark, sf_dir)
    return de.de_normalised_counts(c, de.de_size_factors(c))


_TMM_SQL = """
WITH lib AS (SELECT sample, CAST(sum(value) AS DOUBLE) AS L FROM counts GROUP BY sample),
j AS (SELECT c.gene, c.sample, CAST(c.value AS DOUBLE) AS x, lib.L FROM counts c JOIN lib USING (sample)),
uq AS (SELECT sample, quantile_cont(x / L, 0.75) AS uq FROM j GROUP BY sample),
ref AS (SELECT sample FROM uq ORDER BY abs(uq - (SELECT avg(uq) FROM uq)), sample LIMIT 1),
rc AS (SELECT j.gene, j.x AS rx, j.L AS rl FROM j JOIN ref USING (sample)),
mv AS (SELECT j.sample, log2((x / L) / (rx / rl)) AS M, (log2(x / L) + log2(rx / rl)) / 2 AS A,
              (L - x) / L / x + (rl - rx) / rl / rx AS v
       FROM j JOIN rc USING (gene) WHERE x > 0 AND rx > 0),
mv2 AS (SELECT * FROM mv WHERE A > -1e10),
rk AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n,
          rank() OVER (PARTITION BY sample ORDER BY M) + (count(*) OVER (PARTITION BY sample, M) - 1) / 2.0 AS rM,
          rank() OVER (PARTITION BY sample ORDER BY A) + (count(*) OVER (PARTITION BY sample, A) - 1) / 2.0 AS rA,
          max(abs(M)) OVER (PARTITION BY sample) AS maxM
       FROM mv2),
k AS (SELECT *, floor(n * 0.3) + 1 AS loL, floor(n * 0.05) + 1 AS loS FROM rk),
per AS (SELECT sample,
          sum(CASE WHEN rM >= loL AND rM <= n + 1 - loL AND rA >= loS AND rA <= n + 1 - loS THEN M / v END) AS num,
          sum(CASE WHEN rM >= loL AND rM <= n + 1 - loL AND rA >= loS AND rA <= n + 1 - loS THEN 1.0 / v END) AS den,
          max(maxM) AS maxM
        FROM k GROUP BY sample),
f AS (SELECT lib.sample, coalesce(CASE WHEN per.maxM < 1e-6 THEN 1.0 ELSE pow(2.0, coalesce(num / den, 0.0)) END, 1.0) AS f
      FROM lib LEFT JOIN per USING (sample))
SELECT sample, f / exp(avg(ln(f)) OVER ()) AS norm_factor FROM f"""


@register("de_tmm", _TMM_SQL, ("counts",), doubles=("norm_factor",))
def q_de_tmm(spark, sf_dir):
    return de.de_tmm(fx.counts(spark, sf_dir))


@register("de_cpm", """
WITH lib AS (SELECT sample, CAST(sum(value) AS DOUBLE) AS L FROM counts GROUP BY sample),
ps AS (SELECT sample, L, 2.0 * L / avg(L) OVER () AS p FROM lib)
SELECT gene, sample, grp, value, log2((value + p) / (L + 2 * p) * 1e6) AS cpm
FROM counts JOIN ps USING (sample)""", ("counts",), doubles=("cpm",))
def q_de_cpm(spark, sf_dir):
    return de.de_cpm(fx.counts(spark, sf_dir), log=True, prior_count=2.0)


@register("de_voom", """
WITH lib AS (SELECT sample, CAST(sum(value) AS DOUBLE) AS L FROM counts GROUP BY sample)
SELECT gene, sample, grp, log2((value + 0.5) / (L + 1) * 1e6) AS logcpm FROM counts JOIN lib USING (sample)""",
          ("counts",), doubles=("logcpm",))
def q_de_voom(spark, sf_dir):
    """logCPM of voom (the SQL-checkable part; weights are tested in tests/)."""
    c = fx.counts(spark, sf_dir)
    return de.de_voom(c, fx.coldata(spark, sf_dir)).select("gene", "sample", "grp", "logcpm")


_LINFIT_SQL = """
WITH y AS (SELECT gene, grp, log2(value + 1) AS y FROM counts),
a AS (SELECT gene,
        count(*) FILTER (WHERE grp = 'case') AS W1, count(*) FILTER (WHERE grp = 'control') AS W0,
        sum(y) FILTER (WHERE grp = 'case') AS Y1, sum(y) FILTER (WHERE grp = 'control') AS Y0,
        var_samp(y) FILTER (WHERE grp = 'case') AS v1, var_samp(y) FILTER (WHERE grp = 'control') AS v0,
        count(*) AS n, avg(y) AS AveExpr FROM y GROUP BY gene)
SELECT gene, Y1 / W1 - Y0 / W0 AS logFC, Y0 / W0 AS intercept,
       ((W1 - 1) * v1 + (W0 - 1) * v0) / (n - 2) AS sigma2, CAST(n - 2 AS DOUBLE) AS df,
       sqrt(1.0 / W1 + 1.0 / W0) AS stdev_unscaled, AveExpr FROM a"""


@register("de_linear_fit", _LINFIT_SQL, ("counts",),
          doubles=("logFC", "intercept", "sigma2", "df", "stdev_unscaled", "AveExpr"))
def q_de_linear_fit(spark, sf_dir):
    c = fx.counts(spark, sf_dir).withColumn("value", F.log2(F.col("value") + 1))
    return de.de_linear_fit(c, None)


#: every difference of two of the three levels, from the groups' means
_FACTOR_SQL = """
WITH m AS (SELECT gene, grp, avg(y) AS m, count(*) AS n, coalesce(var_samp(y), 0) * (count(*) - 1) AS ss FROM thirds GROUP BY 1, 2),
a AS (SELECT gene, sum(m * n) / sum(n) AS AveExpr, sum(ss) / (sum(n) - 3) AS sigma2, CAST(sum(n) - 3 AS DOUBLE) AS df FROM m GROUP BY 1),
c AS (SELECT * FROM (VALUES ('middle', 'middle', 'early'), ('late', 'late', 'early'), ('late - middle', 'late', 'middle')) v(coefficient, hi, lo))
SELECT a.gene, c.coefficient, h.m - l.m AS logFC, e.m AS intercept, sigma2, df, sqrt(1.0 / h.n + 1.0 / l.n) AS stdev_unscaled, AveExpr
FROM a, c JOIN m h ON h.gene = a.gene AND h.grp = c.hi JOIN m l ON l.gene = a.gene AND l.grp = c.lo
JOIN m e ON e.gene = a.gene AND e.grp = 'early'"""


def _factor_fit(spark, sf_dir):
    return dg.design_fit(fx.log_counts_by_third(spark, sf_dir), levels=["early", "middle", "late"],
                         contrasts={"middle": {"middle": 1}, "late": {"late": 1}, "late - middle": {"late": 1, "middle": -1}})


@register("de_factor_fit", _FACTOR_SQL, ("thirds",),
          doubles=("logFC", "intercept", "sigma2", "df", "stdev_unscaled", "AveExpr"))
def q_de_factor_fit(spark, sf_dir):
    """A factor of three levels: each level against the first, and a contrast of the other two."""
    return _factor_fit(spark, sf_dir)


@register("de_factor_top_table")
def q_de_factor_top_table(spark, sf_dir):
    """Moderated t, FDR and B of every gene for a chosen coefficient; checked against numpy in tests/."""
    return dg.coefficient_table(_factor_fit(spark, sf_dir), "late")


def _shifted(x: str, term: str, tail: str) -> str:
    """Series with the argument shifted up by 20 (as functions/special.py)."""
    parts = [term.format(y=f"({x} + {k})") for k in range(20)]
    return "(" + " + ".join(parts) + " + " + tail.format(z=f"({x} + 20)") + ")"


def _digamma_sql(x: str) -> str:
    return _shifted(x, "-1.0 / {y}",
                    "ln({z}) - 0.5 / {z} - (1.0 / ({z} * {z})) * (1.0 / 12 - (1.0 / ({z} * {z})) * (1.0 / 120"
                    " - (1.0 / ({z} * {z})) * (1.0 / 252 - (1.0 / ({z} * {z})) * (1.0 / 240"
                    " - (1.0 / ({z} * {z})) * (1.0 / 132)))))")


def _trigamma_sql(x: str) -> str:
    return _shifted(x, "1.0 / ({y} * {y})",
                    "1.0 / {z} + (1.0 / ({z} * {z})) / 2.0 + (1.0 / ({z} * {z})) / {z} * (1.0 / 6"
                    " - (1.0 / ({z} * {z})) * (1.0 / 30 - (1.0 / ({z} * {z})) * (1.0 / 42"
                    " - (1.0 / ({z} * {z})) * (1.0 / 30))))")


def _tetragamma_sql(x: str) -> str:
    return _shifted(x, "-2.0 / ({y} * {y} * {y})",
                    "-1.0 / ({z} * {z}) - 1.0 / ({z} * {z} * {z}) - (1.0 / ({z} * {z})) * (1.0 / ({z} * {z}))"
                    " * (0.5 - (1.0 / ({z} * {z})) * (1.0 / 6 - (1.0 / ({z} * {z})) * (1.0 / 6"
                    " - (1.0 / ({z} * {z})) * 0.3)))")


def _moderated_sql() -> str:
    stages = ["n0 AS (SELECT *, 0.5 + 1.0 / evar AS x, false AS done FROM mom)"]
    for i in range(1, 40):
        dif = f"({_trigamma_sql('x')}) * (1 - ({_trigamma_sql('x')}) / evar) / ({_tetragamma_sql('x')})"
        stages.append(
            f"n{i} AS (SELECT emean, evar, total_df, CASE WHEN done THEN x ELSE x + d END AS x, "
            f"done OR (-d / (x + d) < 1e-8) AS done "
            f"FROM (SELECT emean, evar, total_df, x, done, {dif} AS d FROM n{i - 1}))")
    inv = ("CASE WHEN evar > 1e7 THEN 1.0 / sqrt(evar) WHEN evar < 1e-6 THEN 1.0 / evar ELSE x END")
    return f"""
WITH fit AS ({_LINFIT_SQL}),
e AS (SELECT ln(sigma2) - ({_digamma_sql('df / 2')}) + ln(df / 2) AS e, {_trigamma_sql('df / 2')} AS tg, df
      FROM fit WHERE sigma2 > 0),
mom AS (SELECT avg(e) AS emean, var_samp(e) - avg(tg) AS evar, sum(df) AS total_df FROM e),
{', '.join(stages)},
pr AS (SELECT emean, evar, total_df, 2 * ({inv}) AS d0 FROM n39),
pr2 AS (SELECT *, exp(emean + ({_digamma_sql('d0 / 2')}) - ln(d0 / 2)) AS s02 FROM pr)
SELECT fit.*, (d0 * s02 + fit.df * fit.sigma2) / (d0 + fit.df) AS s2_post,
       logFC / (stdev_unscaled * sqrt((d0 * s02 + fit.df * fit.sigma2) / (d0 + fit.df))) AS t,
       least(fit.df + d0, total_df) AS df_total, d0 AS df_prior, s02 AS s2_prior
FROM fit, pr2"""


@register("de_moderated_t", _moderated_sql(), ("counts",),
          doubles=("logFC", "intercept", "sigma2", "df", "stdev_unscaled", "AveExpr", "s2_post", "t",
                   "df_total", "df_prior", "s2_prior"))
def q_de_moderated_t(spark, sf_dir):
    """Moderated t on log2(count+1).  The prior (digamma, trigamma, Newton
    inverse) is checked by SQL; the incomplete-beta p-value by tests/."""
    c = fx.counts(spark, sf_dir).withColumn("value", F.log2(F.col("value") + 1))
    return de.de_moderated_t(de.de_linear_fit(c, None)).drop("PValue")


_POOLED_SQL = f"""
WITH y AS (SELECT gene, grp, log2(value + 1) AS y FROM counts),
a AS (SELECT gene,
        avg(y) FILTER (WHERE grp = 'case') AS m1, avg(y) FILTER (WHERE grp = 'control') AS m0,
        var_samp(y) FILTER (WHERE grp = 'case') AS v1, var_samp(y) FILTER (WHERE grp = 'control') AS v0,
        count(y) FILTER (WHERE grp = 'case') AS n1, count(y) FILTER (WHERE grp = 'control') AS n0,
        avg(y) AS AveExpr FROM y GROUP BY gene),
t AS (SELECT gene, m1 - m0 AS logFC, AveExpr,
        ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0) AS se2,
        CAST(n1 + n0 - 2 AS DOUBLE) AS df FROM a),
tt AS (SELECT gene, logFC, AveExpr, CASE WHEN se2 > 0 THEN logFC / sqrt(se2) END AS t, df FROM t)
SELECT *, {t_p_even_sql('t', 10)} AS PValue FROM tt"""


@register("de_welch_or_pooled_t", _POOLED_SQL, ("counts",),
          doubles=("logFC", "AveExpr", "t", "df", "PValue"))
def q_de_pooled_t(spark, sf_dir):
    c = fx.counts(spark, sf_dir).withColumn("value", F.log2(F.col("value") + 1))
    return de.de_welch_or_pooled_t(c, None)


@register("de_bh_adjust", f"""
WITH pt AS ({_POOLED_SQL})
{bh_sql('pt', 'PValue', 'gene')}""", ("counts",), doubles=("logFC", "AveExpr", "t", "df", "PValue", "FDR"))
def q_de_bh_adjust(spark, sf_dir):
    c = fx.counts(spark, sf_dir).withColumn("value", F.log2(F.col("value") + 1))
    return de.de_bh_adjust(de.de_welch_or_pooled_t(c, None))


@register("de_top_table", f"""
WITH pt AS ({_POOLED_SQL}), b AS ({bh_sql('pt', 'PValue', 'gene')})
SELECT gene, logFC, AveExpr, t, PValue, FDR FROM b ORDER BY PValue, gene""", ("counts",),
          doubles=("logFC", "AveExpr", "t", "PValue", "FDR"))
def q_de_top_table(spark, sf_dir):
    c = fx.counts(spark, sf_dir).withColumn("value", F.log2(F.col("value") + 1))
    return de.de_top_table(de.de_welch_or_pooled_t(c, None))


_NB_SQL = """
WITH nz AS (SELECT gene FROM counts GROUP BY gene HAVING min(value) > 0),
l AS (SELECT c.gene, c.sample, ln(c.value) AS lx FROM counts c JOIN nz USING (gene)),
r AS (SELECT sample, lx - avg(lx) OVER (PARTITION BY gene) AS r FROM l),
sf AS (SELECT sample, exp(median(r)) AS s FROM r GROUP BY sample),
q AS (SELECT gene, grp, value / s AS q, 1.0 / s AS iz FROM counts JOIN sf USING (sample)),
a AS (SELECT gene,
        avg(q) FILTER (WHERE grp = 'case') AS mu1, avg(q) FILTER (WHERE grp = 'control') AS mu0,
        var_samp(q) FILTER (WHERE grp = 'case') AS v1, var_samp(q) FILTER (WHERE grp = 'control') AS v0,
        avg(iz) FILTER (WHERE grp = 'case') AS z1, avg(iz) FILTER (WHERE grp = 'control') AS z0,
        count(*) FILTER (WHERE grp = 'case') AS n1, count(*) FILTER (WHERE grp = 'control') AS n0,
        avg(q) AS baseMean FROM q GROUP BY gene),
d AS (SELECT *, CASE WHEN mu1 > 0 AND mu0 > 0 THEN greatest(0.0, ((v1 - mu1 * z1) / (mu1 * mu1)
                     + (v0 - mu0 * z0) / (mu0 * mu0)) / 2) END AS dispersion FROM a),
e AS (SELECT gene, baseMean, dispersion,
        CASE WHEN mu1 > 0 AND mu0 > 0 THEN log2(mu1 / mu0) END AS logFC,
        CASE WHEN mu1 > 0 AND mu0 > 0 THEN sqrt((z1 / mu1 + dispersion) / n1 + (z0 / mu0 + dispersion) / n0) / ln(2) END AS lfcSE
      FROM d)
SELECT *, logFC / lfcSE AS stat FROM e"""


@register("de_nb_two_group", _NB_SQL, ("counts",),
          doubles=("baseMean", "dispersion", "logFC", "lfcSE", "stat"))
def q_de_nb_two_group(spark, sf_dir):
    """NB Wald-type test; the normal p (no erf in DuckDB) is tested in tests/."""
    c = fx.counts(spark, sf_dir)
    out = de.de_nb_two_group(c, fx.coldata(spark, sf_dir), de.de_size_factors(c))
    return out.drop("PValue")


_DECIDE_SQL = """
SELECT *, CASE WHEN FDR < 0.3 AND abs(logFC) >= 0.2 THEN CAST(sign(logFC) AS INTEGER) ELSE 0 END AS decision
FROM deg"""


@register("de_decide", _DECIDE_SQL, ("deg",), doubles=("logFC", "logCPM", "PValue", "FDR"))
def q_de_decide(spark, sf_dir):
    return de.de_decide(fx.deg(spark, sf_dir), p_cut=0.3, lfc_cut=0.2)


@register("de_up_down_summary", f"""
WITH d AS ({_DECIDE_SQL}),
lab AS (SELECT CASE WHEN decision < 0 THEN 'Down' WHEN decision > 0 THEN 'Up' ELSE 'NotSig' END AS direction FROM d),
g AS (SELECT direction, count(*) AS n_genes FROM lab GROUP BY direction)
SELECT a.direction, CAST(coalesce(g.n_genes, 0) AS BIGINT) AS n_genes
FROM (VALUES ('Down'), ('NotSig'), ('Up')) a(direction) LEFT JOIN g USING (direction)""", ("deg",))
def q_de_up_down_summary(spark, sf_dir):
    return de.de_up_down_summary(de.de_decide(fx.deg(spark, sf_dir), p_cut=0.3, lfc_cut=0.2))


@register("deg_select", """
SELECT *, CASE WHEN PValue < 0.05 AND logFC > 0.3 THEN 'up' ELSE 'down' END AS direction FROM deg
WHERE PValue < 0.05 AND (logFC > 0.3 OR logFC < -0.3)""", ("deg",),
          doubles=("logFC", "logCPM", "PValue", "FDR"))
def q_deg_select(spark, sf_dir):
    return de.deg_select(fx.deg(spark, sf_dir), p_cut=0.05, lfc_cut=0.3)


@register("volcano_classify", """
SELECT *, CASE WHEN logFC >= 0.3 AND PValue <= 0.05 THEN 'red'
               WHEN logFC <= -0.3 AND PValue <= 0.05 THEN 'blue' ELSE 'grey' END AS colour,
       CASE WHEN PValue > 0 THEN -log10(PValue) END AS neg_log10_p FROM deg""", ("deg",),
          doubles=("logFC", "logCPM", "PValue", "FDR", "neg_log10_p"))
def q_volcano_classify(spark, sf_dir):
    return de.volcano_classify(fx.deg(spark, sf_dir), lfc_cut=0.3, p_cut=0.05)


@register("volcano_top_labels", """
SELECT * FROM deg WHERE PValue IS NOT NULL ORDER BY PValue, GeneSymbol LIMIT 20""", ("deg",),
          doubles=("logFC", "logCPM", "PValue", "FDR"))
def q_volcano_top_labels(spark, sf_dir):
    return de.volcano_top_labels(fx.deg(spark, sf_dir), n=20)
