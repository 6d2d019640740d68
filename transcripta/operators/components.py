"""Principal components of samples by a randomised range finder.

The z-scored cells stay a long table.  A basis of l = k + ``oversample``
columns over the samples is a table of one row per sample; a product with the
cells is a join and one sum per basis column.  Bases are made orthonormal by a
blockwise QR: partitions factor their rows batch by batch, the small triangles
are factored again in groups, and only l x l numbers reach the driver.  The
scores are a table throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transcripta.session import cut_lineage, ship_package

#: So many times the asked basis columns are taken where that makes one product exact.
EXACT = 4


def r_factor(df: DataFrame, cols: list[str]) -> np.ndarray:
    """The triangle of the QR decomposition of the columns (at most l rows)."""
    def factor(batches):
        r = np.zeros((0, len(cols)))
        for pdf in batches:
            r = np.linalg.qr(np.vstack([r, pdf[cols].to_numpy(float)]), mode="r")
        yield pd.DataFrame(r, columns=cols)

    schema = ", ".join(f"`{c}` double" for c in cols)
    groups = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = df.select(*cols).mapInPandas(factor, schema).repartition(groups).mapInPandas(factor, schema).collect()
    return np.linalg.qr(np.array([list(r) for r in parts], float).reshape(-1, len(cols)), mode="r")


def rotated(df: DataFrame, key: str, cols: list[str], matrix: np.ndarray, out: list[str]) -> DataFrame:
    """``key`` and the columns times a small matrix."""
    def times(batches):
        for pdf in batches:
            made = pd.DataFrame(pdf[cols].to_numpy(float) @ matrix, columns=out)
            made.insert(0, key, pdf[key].to_numpy())
            yield made

    kind = df.schema[key].dataType.simpleString()
    return df.mapInPandas(times, f"`{key}` {kind}, " + ", ".join(f"`{c}` double" for c in out))


def orthonormal(df: DataFrame, key: str, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """An orthonormal basis of the columns' span; directions below rounding are left out."""
    for _ in range(2):  # the second time the columns are well conditioned
        _, s, wt = np.linalg.svd(r_factor(df, cols), full_matrices=False)
        some = s > s[0] * len(cols) * 1e-15
        kept = [f"_c{j}" for j in range(int(some.sum()))]
        df, cols = cut_lineage(rotated(df, key, cols, wt[some].T / s[some], kept), "basis"), kept
    return df, cols


def _normal(key: str, j: int, seed: int) -> Column:
    """A standard normal number of the row's key: the same however rows are partitioned."""
    def uniform(i: int) -> Column:
        return (F.pmod(F.xxhash64(key, F.lit(i), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(uniform(2 * j))) * F.cos(2 * math.pi * uniform(2 * j + 1))


def _product(cells: DataFrame, basis: DataFrame, by: str, to: str, cols: list[str]) -> DataFrame:
    return cells.join(basis, by).groupBy(to).agg(*[F.sum(F.col("z") * F.col(c)).alias(c) for c in cols])


def _residual(moved: DataFrame, basis: DataFrame, key: str, cols: list[str], w: np.ndarray, lam: np.ndarray) -> float:
    """The largest length of A'A v - lambda v over the wanted components."""
    n = len(cols)
    both = moved.join(basis.select(key, *[F.col(c).alias(f"q{c}") for c in cols]), key)
    names = [f"r{j}" for j in range(len(lam))]

    def squares(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(float) @ w - (pdf[[f"q{c}" for c in cols]].to_numpy(float) @ w) * lam
            yield pd.DataFrame([(x * x).sum(0)], columns=names)

    row = both.mapInPandas(squares, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c) for c in names]).first()
    return math.sqrt(max(v or 0.0 for v in row)) if n else 0.0


def pca(expr: DataFrame, k: int = 10, gene: str = "gene", sample: str = "sample", value: str = "value",
        oversample: int = 8, tol: float = 1e-7, seed: int = 11) -> dict:
    """Principal components of samples (genes centred and scaled).

    Returns ``{"scores": (sample, PC1..PCk), "explained": (pc, sdev,
    proportion), "genes": (gene, PC1..PCk), "status"}``; ``genes`` holds the
    genes' coordinates on the components' unit vectors over the samples.  With
    fewer than 3 samples or no gene that varies the status is "insufficient"
    and every table states it.  A cell occurs once; absent cells count 0 after
    scaling.  The largest score of a component is positive (ties: of the
    smallest sample).

    With as many basis columns as samples one product is exact; so it is made
    where there are at most ``EXACT`` times the asked columns' samples, since a
    power step costs two products and close eigenvalues take many.  Otherwise
    power steps go on until every wanted pair (lambda, v) of A'A has a residual
    of at most ``tol`` times the largest lambda.
    """
    from transcripta.operators.multivariate import zscore_genes
    spark = expr.sparkSession
    ship_package(spark)
    expr = cut_lineage(expr.select(gene, sample, value), "expr")  # read by the genes' statistics and by the join with them
    cells = cut_lineage(zscore_genes(expr, gene, value).select(gene, sample, "z"), "cells")
    names = cells.select(sample).distinct()
    n_samples, n_genes = names.count(), cells.select(gene).distinct().count()
    if n_samples < 3 or n_genes == 0:
        none = spark.createDataFrame([("insufficient samples", n_samples)], "status string, n_samples long")
        return {"scores": none, "explained": none, "genes": none, "status": "insufficient"}
    n_cols = n_samples if n_samples <= EXACT * (k + oversample) else k + oversample
    cols = [f"_c{j}" for j in range(n_cols)]
    start = names.select(sample, *[_normal(sample, j, seed).alias(c) for j, c in enumerate(cols)])
    basis, cols = orthonormal(cut_lineage(start, "basis"), sample, cols)
    while True:
        image = cut_lineage(_product(cells, basis, sample, gene, cols), "image")
        _, s, wt = np.linalg.svd(r_factor(image, cols), full_matrices=False)
        kk = max(1, min(k, n_samples - 1, n_genes, int((s > 1e-9 * s[0]).sum())))
        w, s = wt[:kk].T, s[:kk]
        if len(cols) == n_samples:
            break
        moved = cut_lineage(_product(cells, image, gene, sample, cols), "moved")
        if _residual(moved, basis, sample, cols, w, s * s) <= tol * s[0] ** 2:
            break
        basis, cols = orthonormal(moved, sample, cols)
    pcs = [f"PC{j + 1}" for j in range(kk)]
    scores = cut_lineage(rotated(basis, sample, cols, w * s, pcs), "scores")
    top = scores.agg(*[F.min(F.struct((-F.abs(c)).alias("a"), F.col(sample).alias("s"), F.col(c).alias("v"))).alias(c)
                       for c in pcs]).first()
    sign = np.array([-1.0 if top[c]["v"] < 0 else 1.0 for c in pcs])
    signed = [(F.col(c) * float(g)).alias(c) for c, g in zip(pcs, sign)]
    explained = [(c, float(x / math.sqrt(n_samples - 1)), float(x * x / ((n_samples - 1) * n_genes))) for c, x in zip(pcs, s)]
    return {"scores": scores.select(F.col(sample).alias("sample"), *signed),
            "explained": spark.createDataFrame(explained, "pc string, sdev double, proportion double"),
            "genes": rotated(image, gene, cols, w * sign, pcs), "status": "ok"}
