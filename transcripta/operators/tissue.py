"""Tissue typing: rank a reference panel's tissues by Kendall tau-b
against each sample profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcripta.functions.columns import nan_to_null
from transcripta.operators.pairwise import kendall_pairs
from transcripta.session import cut_lineage


def panel_gene_max(panel: DataFrame, gene: str = "gene", tissue: str = "tissue",
                   value: str = "value") -> DataFrame:
    """Max per gene symbol and tissue over duplicate rows (NaN ignored)."""
    return panel.groupBy(gene, tissue).agg(F.max(nan_to_null(F.col(value))).alias(value))


def tissue_typing(panel: DataFrame, profiles: DataFrame, include: DataFrame | None = None,
                  exclude: DataFrame | None = None, exclude_self: bool = True, gene: str = "gene",
                  tissue: str = "tissue", value: str = "value", p_gene: str = "Gene",
                  p_sample: str = "sample", p_value: str = "max_TPM") -> DataFrame:
    """Rank every panel tissue (and every other sample) for each sample.

    panel max -> genes present in every tissue and every sample (the right
    join chain followed by complete cases, in long form) -> include/exclude
    genes -> Kendall tau-b of each sample against each column -> rank by tau
    (desc, then column name) per sample.  ``(sample, column, tau, n, rank)``.
    """
    pm = panel_gene_max(panel, gene, tissue, value).filter(F.col(value).isNotNull())
    pr = (profiles.select(F.col(p_gene).alias(gene), F.col(p_sample).alias("sample"),
                          nan_to_null(F.col(p_value).cast("double")).alias(value))
          .filter(F.col(value).isNotNull()))
    # read by the counts, the gene index, both packs and the block sizing: the
    # panel and the profiles are derived once
    cols = cut_lineage(pm.select(gene, F.col(tissue).alias("column"), value, F.lit(False).alias("_own"))
                       .unionByName(pr.select(gene, F.col("sample").alias("column"), value, F.lit(True).alias("_own"))), "columns")
    own = cols.filter("_own").select("column").distinct()
    n_cols = cols.select("column").distinct().count()
    complete = (cols.groupBy(gene).agg(F.countDistinct("column").alias("_n"))
                .filter(F.col("_n") == n_cols).select(gene))
    if include is not None:
        complete = complete.join(include.select(F.col(include.columns[0]).alias(gene)), gene, "left_semi")
    if exclude is not None:
        complete = complete.join(exclude.select(F.col(exclude.columns[0]).alias(gene)), gene, "left_anti")
    cols = cut_lineage(cols.drop("_own").join(complete, gene, "left_semi"), "typing_cols")
    samples = cols.join(own, "column", "left_semi").withColumnRenamed("column", "sample")
    tau = kendall_pairs(samples, cols, key=gene, a_col="sample", b_col="column", value=value)
    if exclude_self:
        tau = tau.filter(F.col("sample") != F.col("column"))
    w = Window.partitionBy("sample").orderBy(F.col("tau").desc(), F.col("column"))
    return tau.withColumn("rank", F.row_number().over(w))
