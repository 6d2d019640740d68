"""Registered join / set queries and comparison queries (2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from transcripta.operators import compare as cmp
from transcripta.operators import de
from transcripta.operators import joins as jn
from transcripta.plans import fixtures as fx
from transcripta.plans.registry import register

TISSUES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_DEG_D = ("logFC", "logCPM", "PValue", "FDR")


@register("join_first_match", """
WITH r AS (SELECT Gene, main_code || '_' || sub_code AS sample_name, main_code, sub_code, value,
                  row_number() OVER (PARTITION BY Gene ORDER BY main_code || '_' || sub_code) AS rn
           FROM long_expr WHERE normalization = 'max_TPM')
SELECT g.gene_id AS Gene, g.gene_name, r.main_code, r.sub_code, r.value, r.sample_name
FROM gene_info g LEFT JOIN r ON r.Gene = g.gene_id AND r.rn = 1""", ("gene_info", "long_expr"),
          doubles=("value",))
def q_join_first_match(spark, sf_dir):
    left = fx.gene_info(spark, sf_dir).select(F.col("gene_id").alias("Gene"), "gene_name")
    right = (fx.long_expr(spark, sf_dir).filter(F.col("normalization") == "max_TPM")
             .select("Gene", F.concat_ws("_", "main_code", "sub_code").alias("sample_name"),
                     "main_code", "sub_code", "value"))
    return jn.join_first_match(left, right, "Gene", "sample_name")


def _panel_wide(spark, sf_dir):
    return fx.panel(spark, sf_dir).groupBy("gene").pivot("tissue", TISSUES).agg(F.max("value"))


def _profile(spark, sf_dir, s):
    return (fx.profiles(spark, sf_dir).filter(F.col("sample") == s)
            .select(F.col("Gene").alias("gene"), F.col("max_TPM").alias(s)))


_PANEL_WIDE_SQL = ("SELECT gene, " + ", ".join(
    f"max(value) FILTER (WHERE tissue = '{t}') AS \"{t}\"" for t in TISSUES) + " FROM panel GROUP BY gene")


def _prof_sql(s):
    return f"SELECT Gene AS gene, max_TPM AS {s} FROM profiles WHERE sample = '{s}'"


@register("join_right_chain", f"""
SELECT c.gene, {', '.join(f'pw."{t}"' for t in TISSUES)}, a.P_A, n.P_N, c.P_R
FROM pw RIGHT JOIN pa a ON pw.gene = a.gene RIGHT JOIN pn n ON a.gene = n.gene RIGHT JOIN pr c ON n.gene = c.gene""",
          ("panel", "profiles"), doubles=tuple(TISSUES) + ("P_A", "P_N", "P_R"),
          extra=[("pw", _PANEL_WIDE_SQL), ("pa", _prof_sql("P_A")), ("pn", _prof_sql("P_N")),
                 ("pr", _prof_sql("P_R"))])
def q_join_right_chain(spark, sf_dir):
    frames = [_panel_wide(spark, sf_dir)] + [_profile(spark, sf_dir, s) for s in ("P_A", "P_N", "P_R")]
    return jn.join_right_chain(frames, "gene")


@register("map_gene_ids", """
SELECT d.*, m.ENTREZID FROM deg d JOIN (SELECT DISTINCT SYMBOL, ENTREZID FROM id_map WHERE organism = 'hsa') m
ON m.SYMBOL = d.GeneSymbol""", ("deg", "id_map"), doubles=_DEG_D)
def q_map_gene_ids(spark, sf_dir):
    return jn.map_gene_ids(fx.deg(spark, sf_dir), fx.id_map(spark, sf_dir), "hsa")


@register("align_experiment", """
SELECT c.gene, c.sample, c.value, d.logFC, d.logCPM, d.PValue, d.FDR, cd.grp
FROM counts c JOIN deg d ON d.GeneSymbol = c.gene LEFT JOIN coldata cd ON cd.sample = c.sample""",
          ("counts", "deg", "coldata"), doubles=_DEG_D)
def q_align_experiment(spark, sf_dir):
    return jn.align_experiment(fx.counts(spark, sf_dir).drop("grp"), fx.deg(spark, sf_dir),
                               fx.coldata(spark, sf_dir))


_SEL_SQL = """
sel AS (SELECT GeneSymbol, CASE WHEN logFC > 0.3 THEN 'up' ELSE 'down' END AS direction FROM deg
        WHERE PValue < 0.05 AND (logFC > 0.3 OR logFC < -0.3)),
promo AS (SELECT gene_id AS gene FROM gene_info WHERE gene_type = 'PROMO')"""


@register("set_gene_lists", """
SELECT 'union' AS op, gene FROM (SELECT GeneSymbol AS gene FROM sel WHERE direction = 'up'
                                 UNION SELECT GeneSymbol FROM sel WHERE direction = 'down')
UNION ALL SELECT 'intersect', gene FROM (SELECT GeneSymbol AS gene FROM sel INTERSECT SELECT gene FROM promo)
UNION ALL SELECT 'difference', gene FROM (SELECT GeneSymbol AS gene FROM sel EXCEPT SELECT gene FROM promo)
UNION ALL SELECT 'unique', gene FROM (SELECT DISTINCT GeneSymbol AS gene FROM sel)""",
          ("deg", "gene_info"), extra=[("sel", _SEL_SQL.split("AS (", 1)[1].split("),\npromo")[0]),
                                       ("promo", "SELECT gene_id AS gene FROM gene_info WHERE gene_type = 'PROMO'")])
def q_set_gene_lists(spark, sf_dir):
    sel = de.deg_select(fx.deg(spark, sf_dir), 0.05, 0.3)
    up = sel.filter(F.col("direction") == "up").select("GeneSymbol")
    down = sel.filter(F.col("direction") == "down").select("GeneSymbol")
    promo = fx.gene_info(spark, sf_dir).filter(F.col("gene_type") == "PROMO").select("gene_id")
    allsel = sel.select("GeneSymbol")
    parts = [jn.set_gene_lists(up, down, "union").withColumn("op", F.lit("union")),
             jn.set_gene_lists(allsel, promo, "intersect").withColumn("op", F.lit("intersect")),
             jn.set_gene_lists(allsel, promo, "difference").withColumn("op", F.lit("difference")),
             jn.set_gene_lists(allsel, allsel, "unique").withColumn("op", F.lit("unique"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("op", "gene")


def _g(spark, sf_dir, s):
    return fx.profiles(spark, sf_dir).filter(F.col("sample") == s).select("Gene", "max_TPM")


_CMP_SQL = """
SELECT a.Gene, a.max_TPM + 0.0001 AS tissue, b.max_TPM + 0.0001 AS ctc
FROM (SELECT * FROM profiles WHERE sample = 'P_A') a LEFT JOIN (SELECT * FROM profiles WHERE sample = 'P_R') b
ON a.Gene = b.Gene WHERE a.max_TPM > 1 OR b.max_TPM > 1"""
_SPECIAL_SQL = """
SELECT a.Gene, 'group1' AS rule FROM (SELECT * FROM profiles WHERE sample = 'P_A') a
LEFT JOIN (SELECT * FROM profiles WHERE sample = 'P_R') b ON a.Gene = b.Gene WHERE a.max_TPM < 100 AND b.max_TPM < 0.001
UNION ALL
SELECT a.Gene, 'group2' FROM (SELECT * FROM profiles WHERE sample = 'P_A') a
LEFT JOIN (SELECT * FROM profiles WHERE sample = 'P_R') b ON a.Gene = b.Gene WHERE a.max_TPM < 0.001 AND b.max_TPM < 100"""


@register("cmp_two_samples", _CMP_SQL, ("profiles",), doubles=("tissue", "ctc"))
def q_cmp_two_samples(spark, sf_dir):
    return cmp.cmp_two_samples(_g(spark, sf_dir, "P_A"), _g(spark, sf_dir, "P_R"))


@register("cmp_special_genes", _SPECIAL_SQL, ("profiles",))
def q_cmp_special_genes(spark, sf_dir):
    return cmp.cmp_special_genes(_g(spark, sf_dir, "P_A"), _g(spark, sf_dir, "P_R"))


@register("cmp_outliers", f"""
WITH d AS ({_CMP_SQL}), s AS ({_SPECIAL_SQL}),
o AS (SELECT *, abs(log2(tissue) - log2(ctc)) AS distance_to_diagonal FROM d)
SELECT o.*, CASE WHEN distance_to_diagonal > 7 THEN 'outlier' ELSE 'consistent' END AS colour,
       (distance_to_diagonal > 7) AND o.Gene NOT IN (SELECT Gene FROM s) AS labelled FROM o""",
          ("profiles",), doubles=("tissue", "ctc", "distance_to_diagonal"))
def q_cmp_outliers(spark, sf_dir):
    g1, g2 = _g(spark, sf_dir, "P_A"), _g(spark, sf_dir, "P_R")
    return cmp.cmp_outliers(cmp.cmp_two_samples(g1, g2), cmp.cmp_special_genes(g1, g2), cutoff=7.0)


@register("group_means", """
SELECT gene, avg(value) FILTER (WHERE grp = 'control') AS mean_control,
       avg(value) FILTER (WHERE grp = 'case') AS mean_case,
       CASE WHEN avg(value) FILTER (WHERE grp = 'control') > 0 THEN log2(avg(value) FILTER (WHERE grp = 'control')) END AS log2_control,
       CASE WHEN avg(value) FILTER (WHERE grp = 'case') > 0 THEN log2(avg(value) FILTER (WHERE grp = 'case')) END AS log2_case
FROM counts GROUP BY gene""", ("counts",), doubles=("mean_control", "mean_case", "log2_control", "log2_case"))
def q_group_means(spark, sf_dir):
    return cmp.group_means(fx.counts(spark, sf_dir))


@register("gene_profile", """
SELECT gene, sample, grp, value,
       quantile_cont(value, 0.25) OVER (PARTITION BY grp) AS q1,
       quantile_cont(value, 0.5) OVER (PARTITION BY grp) AS median,
       quantile_cont(value, 0.75) OVER (PARTITION BY grp) AS q3
FROM counts WHERE gene = 'G7'""", ("counts",), doubles=("q1", "median", "q3"))
def q_gene_profile(spark, sf_dir):
    return cmp.gene_profile(fx.counts(spark, sf_dir), "G7")


@register("row_zscore", """
SELECT *, CASE WHEN stddev_samp(value) OVER (PARTITION BY gene) > 0
          THEN (value - avg(value) OVER (PARTITION BY gene)) / stddev_samp(value) OVER (PARTITION BY gene) END AS z
FROM counts""", ("counts",), doubles=("z",))
def q_row_zscore(spark, sf_dir):
    return cmp.row_zscore(fx.counts(spark, sf_dir))


@register("heatmap_tracks", """
WITH x AS (SELECT * FROM counts WHERE gene IN (SELECT GeneSymbol FROM sel)),
z AS (SELECT *, CASE WHEN stddev_samp(value) OVER (PARTITION BY gene) > 0
          THEN (value - avg(value) OVER (PARTITION BY gene)) / stddev_samp(value) OVER (PARTITION BY gene) END AS z FROM x)
SELECT z.*, d.logFC, -log10(CASE WHEN d.PValue IS NULL THEN 1.0 WHEN d.PValue = 0 THEN 2.220446e-16 ELSE d.PValue END) AS neg_log10_p
FROM z LEFT JOIN deg d ON d.GeneSymbol = z.gene""", ("counts", "deg"), doubles=("z", "logFC", "neg_log10_p"),
          extra=[("sel", "SELECT GeneSymbol FROM deg WHERE PValue < 0.05 AND (logFC > 0.3 OR logFC < -0.3)")])
def q_heatmap_tracks(spark, sf_dir):
    d = fx.deg(spark, sf_dir)
    genes = de.deg_select(d, 0.05, 0.3).select("GeneSymbol")
    return cmp.heatmap_tracks(fx.counts(spark, sf_dir), d, genes)
