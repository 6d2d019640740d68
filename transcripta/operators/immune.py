"""Cell-fraction estimation from a signature table.

The solver is re-aimed: Spark adds up each sample's moments over the signature
genes it has values for, and a K-dimensional non-negative least squares follows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcripta.operators.joins import first_order, first_per_key
from transcripta.operators.reshape import complete_cases
from transcripta.session import ship_package


def immune_matrix(g1: DataFrame, g2: DataFrame, names: tuple = ("sample1", "sample2"),
                  gene: str = "Gene", value: str = "max_TPM", order_col: str | None = None) -> DataFrame:
    """Two profiles first-match joined on gene (the first row of the second by
    ``order_col``, without one the smallest value), complete cases, long
    ``(Gene, sample, value)``; required columns are validated."""
    for df in (g1, g2):
        missing = {gene, value} - set(df.columns)
        if missing:
            raise ValueError(f"profile lacks columns {sorted(missing)}")
    r = g2.select(gene, F.col(value).alias(names[1]), first_order(value, order_col).alias("_o"))
    wide = (g1.select(gene, F.col(value).alias(names[0]))
            .join(first_per_key(r, gene, "_o").drop("_o"), gene, "left"))
    wide = complete_cases(wide)
    return wide.unpivot([gene], list(names), "sample", "value")


def nnls(q: np.ndarray, c: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """min 1/2 f'Qf - c'f subject to f >= 0 (Lawson-Hanson active set on the
    normal equations).  Raises when the active sets do not settle."""
    k = len(c)
    f = np.zeros(k)
    passive = np.zeros(k, dtype=bool)
    w = c - q @ f
    it = 0
    while (~passive).any() and (w[~passive] > tol).any():
        it += 1
        if it > 100 * (k + 1):
            raise ArithmeticError("non-negative least squares did not converge")
        t = np.argmax(np.where(passive, -np.inf, w))
        passive[t] = True
        while True:
            z = np.zeros(k)
            idx = np.where(passive)[0]
            z[idx] = np.linalg.lstsq(q[np.ix_(idx, idx)], c[idx], rcond=None)[0]
            if (z[idx] > tol).all():
                f = z
                break
            neg = passive & (z <= tol)
            alpha = np.min(f[neg] / (f[neg] - z[neg]))
            f = f + alpha * (z - f)
            passive &= f > tol
            f[~passive] = 0.0
            if not passive.any():
                break
        w = c - q @ f
    return f


def _cell_types(signature: DataFrame) -> list[str]:
    """Types of the signature in sorted order (K of them, the signature's columns)."""
    return [r[0] for r in signature.select("cell_type").distinct().orderBy("cell_type").collect()]


def _moment_rows(expr: DataFrame, signature: DataFrame, types: list[str], gene: str, sample: str, value: str) -> DataFrame:
    """``sample, i, j, moment``: entries i <= j of S'S, and S'x at j = -1.

    A gene carries its row of the signature and the products of its pairs of
    types as one array; cells add them up per (sample, i, j), in the tasks
    first, so no sample is ever gathered.
    """
    spark = expr.sparkSession
    tix = spark.createDataFrame([(t, i) for i, t in enumerate(types)], "cell_type string, ci int")
    weight = F.col("weight").cast("double")
    row = (signature.join(F.broadcast(tix), "cell_type").filter(weight.isNotNull() & ~F.isnan(weight) & (weight != 0))
           .groupBy(gene, "ci").agg(F.sum(weight).alias("w"))
           .groupBy(gene).agg(F.sort_array(F.collect_list(F.struct("ci", "w"))).alias("s")))
    empty = F.lit(0.0)
    alone = F.transform("s", lambda a: F.struct(a["ci"].alias("i"), F.lit(-1).alias("j"), empty.alias("ww"), a["w"].alias("w")))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(
        F.filter("s", lambda b: b["ci"] >= a["ci"]),
        lambda b: F.struct(a["ci"].alias("i"), b["ci"].alias("j"), (a["w"] * b["w"]).alias("ww"), empty.alias("w")))))
    row = row.select(gene, F.concat(alone, pairs).alias("m"))
    x = F.col(value).cast("double")
    cells = expr.select(gene, F.col(sample).alias("sample"), x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    each = cells.join(row, gene).select("sample", "x", F.explode("m").alias("m"))
    return each.groupBy("sample", F.col("m.i").alias("i"), F.col("m.j").alias("j")).agg(
        F.sum(F.col("m.ww") + F.col("m.w") * F.col("x")).alias("moment"))


def immune_moments(expr: DataFrame, signature: DataFrame, gene: str = "gene", sample: str = "sample", value: str = "value") -> DataFrame:
    """``sample, cell_type, other, moment``: S'S for ``cell_type <= other`` and S'x where ``other`` is null,
    over the signature genes that the sample has a value for; entries of types that share no gene are absent."""
    types = _cell_types(signature)
    names = F.array(*[F.lit(t) for t in types])
    return _moment_rows(expr, signature, types, gene, sample, value).select(
        F.col("sample").alias(sample), F.get(names, F.col("i")).alias("cell_type"), F.get(names, F.col("j")).alias("other"), "moment")


def immune_deconvolve(expr: DataFrame, signature: DataFrame, tumor: bool = False, gene: str = "gene",
                      sample: str = "sample", value: str = "value") -> DataFrame:
    """Fractions ``(sample, cell_type, fraction)`` by non-negative least
    squares of each sample on the signature.

    Both moments of a sample, S^T S and S^T x, come from the same genes: those
    of the signature for which the sample has a value (null and NaN cells are
    left out).  Spark adds the moments up; only K x K numbers per sample meet
    the solver.  Fractions are normalised to sum 1; with ``tumor`` they are
    kept on the signature scale (capped at a total of 1) and the remainder is
    reported as 'uncharacterized'.
    """
    types = _cell_types(signature)
    kk = len(types)
    ship_package(expr.sparkSession)
    moments = (_moment_rows(expr, signature, types, gene, sample, value)
               .groupBy("sample").agg(F.collect_list(F.struct("i", "j", "moment")).alias("m")))  # at most K * (K + 3) / 2

    def solve(batches):
        for pdf in batches:
            names, cells, fractions = [], [], []
            for name, m in zip(pdf["sample"], pdf["m"]):
                sts, c = np.zeros((kk, kk)), np.zeros(kk)
                for e in m:
                    if e["j"] < 0:
                        c[e["i"]] = e["moment"]
                    else:
                        sts[e["i"], e["j"]] = sts[e["j"], e["i"]] = e["moment"]
                f = nnls(sts, c)
                tot = f.sum()
                fr = f / tot if tot > (1 if tumor else 0) else f
                rest = [max(0.0, 1.0 - fr.sum())] if tumor else []
                names += [name] * (kk + len(rest))
                cells += [*types, *["uncharacterized"] * len(rest)]
                fractions += [*fr.tolist(), *rest]
            yield pd.DataFrame({"sample": names, "cell_type": cells, "fraction": np.array(fractions, float)})

    return moments.mapInPandas(solve, "sample string, cell_type string, fraction double").withColumnRenamed("sample", sample)


def immune_fraction_long(wide: DataFrame, id_col: str = "cell_type", value: str = "fraction") -> DataFrame:
    """cell_type x sample wide -> long; ``sample_order`` lists samples in
    reverse order of appearance (last column = 1)."""
    cols = [c for c in wide.columns if c != id_col]
    long_df = wide.unpivot([id_col], cols, "sample", value)
    order = F.array(*[F.lit(c) for c in cols])
    return long_df.withColumn("sample_order",
                              (F.lit(len(cols)) - F.array_position(order, F.col("sample")) + 1).cast("int"))
