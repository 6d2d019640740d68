"""Joins and set operations on gene/sample keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(right: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per key: the first by ``order_col`` (``min_by`` of a struct;
    partial aggregation before the shuffle, so a hot key costs one row per
    map task, not one row per duplicate)."""
    others = [c for c in right.columns if c != key]
    packed = F.min_by(F.struct(*[F.col(c) for c in others]), F.col(order_col))
    return right.groupBy(key).agg(packed.alias("_r")).select(key, "_r.*")


def first_order(value: str, order_col: str | None = None) -> Column:
    """What the first of several rows goes by: ``order_col``, or the smallest value (nulls last)."""
    return F.col(order_col) if order_col else F.struct(F.col(value).isNull(), F.col(value))


def join_first_match(left: DataFrame, right: DataFrame, key: str, order_col: str,
                     how: str = "left") -> DataFrame:
    """Left join taking only the first right row per key (R's ``match``)."""
    return left.join(first_per_key(right, key, order_col), key, how)


def join_right_chain(frames: list[DataFrame], key: str) -> DataFrame:
    """((f0 right-join f1) right-join f2) ... on ``key``: the result keeps the
    keys of the last frame."""
    return reduce(lambda a, b: a.join(b, key, "right"), frames)


def join_scores_coldata(scores: DataFrame, coldata: DataFrame, sample: str = "sample",
                        main: str = "mainCode") -> DataFrame:
    """PCA scores left join the sample table on sample = mainCode."""
    cd = coldata.withColumnRenamed(main, sample) if main in coldata.columns else coldata
    return scores.join(cd, sample, "left")


def map_gene_ids(df: DataFrame, id_map: DataFrame, organism: str = "hsa", gene: str = "GeneSymbol",
                 drop: bool = True, symbol: str = "SYMBOL", entrez: str = "ENTREZID") -> DataFrame:
    """Symbol -> Entrez id through a mapping table (1:n allowed).

    ``drop`` removes unmapped genes (inner join); otherwise they are kept
    with a null id.  The organism filter is a partition filter when the
    mapping table is partitioned by organism.
    """
    m = (id_map.filter(F.col("organism") == organism)
         .select(F.col(symbol).alias(gene), F.col(entrez).alias(entrez)).distinct())
    return df.join(m, gene, "inner" if drop else "left")


def align_experiment(expr: DataFrame, deg: DataFrame, coldata: DataFrame, gene: str = "gene",
                     deg_gene: str = "GeneSymbol", sample: str = "sample") -> DataFrame:
    """Genes present in both expression and DEG table, DEG columns attached
    as gene metadata and the sample table as sample metadata (long form)."""
    d = deg.withColumnRenamed(deg_gene, gene) if deg_gene != gene else deg
    return expr.join(d, gene, "inner").join(coldata, sample, "left")


def set_gene_lists(a: DataFrame, b: DataFrame, op: str, gene: str = "gene") -> DataFrame:
    """union / intersect / difference / unique of one-column gene lists."""
    x = a.select(F.col(a.columns[0]).alias(gene))
    y = b.select(F.col(b.columns[0]).alias(gene))
    if op == "union":
        return x.unionByName(y).distinct()
    if op == "intersect":
        return x.intersect(y)
    if op == "difference":
        return x.subtract(y)
    if op == "unique":
        return x.distinct()
    raise ValueError(f"unknown set operation {op!r}")
