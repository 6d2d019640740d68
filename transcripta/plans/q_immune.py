"""Registered immune-fraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from transcripta.operators import immune as im
from transcripta.plans import fixtures as fx
from transcripta.plans.registry import register


def _g(spark, sf_dir, s):
    return fx.profiles(spark, sf_dir).filter(F.col("sample") == s).select("Gene", "max_TPM")


@register("immune_matrix", """
SELECT Gene, sample, value FROM (
  SELECT a.Gene, a.max_TPM AS sample1, b.max_TPM AS sample2
  FROM (SELECT * FROM profiles WHERE sample = 'P_A') a LEFT JOIN (SELECT * FROM profiles WHERE sample = 'P_R') b USING (Gene)
  WHERE a.max_TPM IS NOT NULL AND b.max_TPM IS NOT NULL AND NOT isnan(a.max_TPM) AND NOT isnan(b.max_TPM))
UNPIVOT (value FOR sample IN (sample1, sample2))""", ("profiles",), doubles=("value",))
def q_immune_matrix(spark, sf_dir):
    return im.immune_matrix(_g(spark, sf_dir, "P_A"), _g(spark, sf_dir, "P_R"))


@register("immune_deconvolve")
def q_immune_deconvolve(spark, sf_dir):
    """Fractions of the 12 count samples on the part-type signature."""
    c = fx.counts(spark, sf_dir).select("gene", "sample", "value")
    return im.immune_deconvolve(c, fx.signature(spark, sf_dir))


@register("immune_deconvolve_tumor")
def q_immune_deconvolve_tumor(spark, sf_dir):
    """Tumour mode: fractions on the signature's scale and the uncharacterised rest."""
    c = fx.counts(spark, sf_dir).select("gene", "sample", "value")
    return im.immune_deconvolve(c, fx.signature(spark, sf_dir), tumor=True)


@register("immune_moments", """
WITH w AS (SELECT g.gene_id AS gene, t.cell_type,
                  CASE WHEN g.gene_type = t.cell_type THEN p.p_retailprice ELSE 1 END AS weight
           FROM gene_info g JOIN part p ON p.p_partkey = g.pos, (SELECT DISTINCT gene_type AS cell_type FROM gene_info) t)
SELECT c.sample, w.cell_type, v.cell_type AS other, sum(w.weight * v.weight) / 999983 AS moment
FROM counts c JOIN w USING (gene) JOIN w v ON v.gene = w.gene AND v.cell_type >= w.cell_type GROUP BY 1, 2, 3
UNION ALL
SELECT c.sample, w.cell_type, NULL, sum(w.weight * c.value) / 999983 FROM counts c JOIN w USING (gene) GROUP BY 1, 2""",
          ("counts", "gene_info"), doubles=("moment",))
def q_immune_moments(spark, sf_dir):
    """Moments of the 12 count samples on the part-type signature; the prime divisor keeps six decimals away from ties."""
    c = fx.counts(spark, sf_dir).select("gene", "sample", "value")
    return im.immune_moments(c, fx.signature(spark, sf_dir)).withColumn("moment", F.col("moment") / 999983)


@register("immune_fraction_long", """
SELECT Gene, sample, max_TPM, CAST(CASE sample WHEN 'P_A' THEN 3 WHEN 'P_N' THEN 2 ELSE 1 END AS INTEGER) AS sample_order
FROM (SELECT Gene, max(max_TPM) FILTER (WHERE sample = 'P_A') AS P_A, max(max_TPM) FILTER (WHERE sample = 'P_N') AS P_N,
             max(max_TPM) FILTER (WHERE sample = 'P_R') AS P_R FROM profiles GROUP BY Gene)
UNPIVOT INCLUDE NULLS (max_TPM FOR sample IN (P_A, P_N, P_R))""", ("profiles",), doubles=("max_TPM",))
def q_immune_fraction_long(spark, sf_dir):
    wide = fx.profiles(spark, sf_dir).groupBy("Gene").pivot("sample", ["P_A", "P_N", "P_R"]).agg(F.max("max_TPM"))
    return im.immune_fraction_long(wide, "Gene", "max_TPM")
