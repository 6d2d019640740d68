"""Two-sample comparison, group summaries, z-scores and heatmap tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcripta.operators.joins import first_order, first_per_key


def cmp_two_samples(g1: DataFrame, g2: DataFrame, names: tuple = ("tissue", "ctc"),
                    gene: str = "Gene", value: str = "max_TPM", order_col: str | None = None,
                    noise: float = 1.0, offset: float = 1e-4) -> DataFrame:
    """First-match join of two profiles on gene; keep genes with either
    value > ``noise``; add ``offset`` to both.  The first match is the first
    row by ``order_col`` of the second profile, without one the smallest value
    (never the layout of partitions).  Output ``(Gene, <n1>, <n2>)``."""
    r = g2.select(gene, F.col(value).alias("_v2"), first_order(value, order_col).alias("_o"))
    j = (g1.select(gene, F.col(value).alias("_v1"))
         .join(first_per_key(r, gene, "_o").drop("_o"), gene, "left"))
    keep = (F.col("_v1") > noise) | (F.col("_v2") > noise)
    return j.filter(keep).select(gene, (F.col("_v1") + offset).alias(names[0]),
                                 (F.col("_v2") + offset).alias(names[1]))


def cmp_special_genes(g1: DataFrame, g2: DataFrame, gene: str = "Gene", value: str = "max_TPM",
                      high: float = 100.0, low: float = 0.001, order_col: str | None = None) -> DataFrame:
    """Genes with (g1 < high and g2 < low) or (g1 < low and g2 < high); a gene
    may appear twice (both lists are put together).  First match as in
    ``cmp_two_samples``."""
    r = g2.select(gene, F.col(value).alias("_v2"), first_order(value, order_col).alias("_o"))
    j = (g1.select(gene, F.col(value).alias("_v1"))
         .join(first_per_key(r, gene, "_o").drop("_o"), gene, "left"))
    a = j.filter((F.col("_v1") < high) & (F.col("_v2") < low)).select(gene, F.lit("group1").alias("rule"))
    b = j.filter((F.col("_v1") < low) & (F.col("_v2") < high)).select(gene, F.lit("group2").alias("rule"))
    return a.unionAll(b)


def cmp_outliers(data: DataFrame, special: DataFrame, x_col: str = "tissue", y_col: str = "ctc",
                 gene: str = "Gene", cutoff: float = 7.0) -> DataFrame:
    """d = |log2 x - log2 y|; 'outlier' above cutoff else 'consistent';
    ``labelled`` = outlier and not in the special list."""
    d = F.abs(F.log2(F.col(x_col)) - F.log2(F.col(y_col)))
    out = data.withColumn("distance_to_diagonal", d).withColumn(
        "colour", F.when(F.col("distance_to_diagonal") > cutoff, "outlier").otherwise("consistent"))
    sp = special.select(F.col(gene).alias("_sg")).distinct().withColumn("_special", F.lit(True))
    return (out.join(sp, out[gene] == sp["_sg"], "left")
            .withColumn("labelled", (F.col("colour") == "outlier") & F.col("_special").isNull())
            .drop("_sg", "_special"))


def group_means(expr: DataFrame, coldata: DataFrame | None = None, case: str = "case",
                control: str = "control", gene: str = "gene", sample: str = "sample",
                value: str = "value", grp: str = "grp") -> DataFrame:
    """Per gene mean in control and in case, and log2 of each."""
    j = expr if grp in expr.columns else expr.join(coldata.select(sample, grp), sample)
    agg = j.groupBy(gene).agg(
        F.avg(F.when(F.col(grp) == control, F.col(value))).alias("mean_control"),
        F.avg(F.when(F.col(grp) == case, F.col(value))).alias("mean_case"))
    return (agg.withColumn("log2_control", F.when(F.col("mean_control") > 0, F.log2("mean_control")))
            .withColumn("log2_case", F.when(F.col("mean_case") > 0, F.log2("mean_case"))))


def gene_profile(expr: DataFrame, gene_name: str, coldata: DataFrame | None = None,
                 gene: str = "gene", sample: str = "sample", value: str = "value",
                 grp: str = "grp") -> DataFrame:
    """All (sample, group, value) rows of one gene with per-group quartiles
    (exact ``percentile``, type-7 interpolation)."""
    j = expr.filter(F.col(gene) == gene_name)
    if grp not in j.columns:
        j = j.join(coldata.select(sample, grp), sample)
    w = Window.partitionBy(grp)
    return j.select(
        gene, sample, grp, value,
        F.percentile(F.col(value), 0.25).over(w).alias("q1"),
        F.percentile(F.col(value), 0.5).over(w).alias("median"),
        F.percentile(F.col(value), 0.75).over(w).alias("q3"))


def row_zscore(expr: DataFrame, gene: str = "gene", value: str = "value", out: str = "z") -> DataFrame:
    """(x - mean)/sd per gene (n-1); zero or undefined variance -> null.

    Per-gene mean and sd are map-side combined aggregates joined back."""
    from transcripta.functions.columns import with_key_stats
    j = with_key_stats(expr, gene, F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    return (j.withColumn(out, F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mu")) / F.col("_sd")))
            .drop("_mu", "_sd"))


def heatmap_tracks(expr: DataFrame, deg: DataFrame, genes: DataFrame, coldata: DataFrame | None = None,
                   gene: str = "gene", deg_gene: str = "GeneSymbol", sample: str = "sample",
                   value: str = "value", grp: str = "grp", p_col: str = "PValue",
                   lfc_col: str = "logFC") -> DataFrame:
    """Rows of a heatmap for a gene list: z-score, group, -log10(p) with
    p = 0 -> 2.220446e-16 and missing p -> 1, and logFC.  Raises when no
    gene matches; without p/logFC columns only the z-scores are returned."""
    keys = genes.select(F.col(genes.columns[0]).alias(gene)).distinct()
    x = expr.join(keys, gene, "left_semi")
    if x.limit(1).count() == 0:
        raise ValueError("no gene of the list is in the expression table")
    if grp not in x.columns and coldata is not None:
        x = x.join(coldata.select(sample, grp), sample, "left")
    z = row_zscore(x, gene, value)
    if p_col not in deg.columns or lfc_col not in deg.columns:
        return z
    d = deg.select(F.col(deg_gene).alias(gene), F.col(p_col).alias("_p"), F.col(lfc_col).alias(lfc_col))
    p = F.when(F.col("_p").isNull(), F.lit(1.0)).when(F.col("_p") == 0, F.lit(2.220446e-16)).otherwise(F.col("_p"))
    return (z.join(d, gene, "left").withColumn("neg_log10_p", -F.log10(p)).drop("_p"))
