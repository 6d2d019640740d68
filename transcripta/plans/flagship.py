"""The minimum slice: which genes differ between case and control?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcripta.functions.columns import round_doubles
from transcripta.operators import de
from transcripta.plans import fixtures as fx


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fx.counts(spark, sf_dir)
    coldata = fx.coldata(spark, sf_dir)
    lib = de.de_lib_size(counts)
    logcpm = de.de_cpm(counts, lib=lib, log=True).select("gene", "sample", F.col("cpm").alias("value"))
    fit = de.de_welch_or_pooled_t(logcpm, coldata)
    res = de.de_bh_adjust(fit)
    res = res.select(F.col("gene").alias("GeneSymbol"), "logFC", F.col("AveExpr").alias("logCPM"),
                     "t", "PValue", "FDR")
    return round_doubles(de.volcano_classify(res, lfc_cut=0.3, p_cut=0.05), 6)
