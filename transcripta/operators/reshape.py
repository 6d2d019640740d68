"""Projection, filters and reshaping between long, wide and annotated forms.

Long ``(gene, sample, value)`` is the internal form.  Wide forms appear
only at the boundary (source tables, small reports); a pivot always gets an
explicit column list, so Spark does not run a separate job to discover it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transcripta.functions.columns import nan_to_null, parse_list
from transcripta.functions.ranking import global_row_number, keyed_running_sum
from transcripta.session import cut_lineage


# ---------------------------------------------------------------------------
# GTF
# ---------------------------------------------------------------------------

def gtf_attr(attribute: Column, key: str) -> Column:
    """Value of ``key "value"`` in GTF attribute text; the greedy prefix makes
    the last occurrence win (so ``ref_gene_id`` shadows ``gene_id``); null
    when the key or its quoted value is absent."""
    return F.nullif(F.regexp_extract(attribute, f'.*{key} "([^"]+)".*', 1), F.lit(""))


def gtf_attributes(gtf: DataFrame, feature: str = "transcript") -> DataFrame:
    """Transcript rows with gene_id, Gene (gene_name), cov, FPKM, TPM."""
    a = F.col("attribute")
    return gtf.filter(F.col("feature") == feature).select(
        gtf_attr(a, "gene_id").alias("gene_id"),
        gtf_attr(a, "gene_name").alias("Gene"),
        gtf_attr(a, "cov").try_cast("double").alias("cov"),
        gtf_attr(a, "FPKM").try_cast("double").alias("FPKM"),
        gtf_attr(a, "TPM").try_cast("double").alias("TPM"))


def gtf_gene_max(attrs: DataFrame, gene: str = "Gene") -> DataFrame:
    """Per gene: max cov / FPKM / TPM ignoring missing (NaN as missing)."""
    return attrs.groupBy(gene).agg(
        F.max(nan_to_null(F.col("cov"))).alias("max_cov"),
        F.max(nan_to_null(F.col("FPKM"))).alias("max_FPKM"),
        F.max(nan_to_null(F.col("TPM"))).alias("max_TPM"))


# ---------------------------------------------------------------------------
# Long <-> wide
# ---------------------------------------------------------------------------

def expr_long_to_wide(long_df: DataFrame, names: list[str] | None = None, main: str = "main_code",
                      sub: str = "sub_code", gene: str = "Gene", value: str = "value") -> DataFrame:
    """Gene x ``main_sub`` sample matrix; absent cell = null; duplicate cells
    resolved by ``max`` (the reference produced list cells)."""
    df = long_df.withColumn("sample_name", F.concat_ws("_", F.col(main), F.col(sub)))
    if names is None:
        names = [r[0] for r in df.select("sample_name").distinct().orderBy("sample_name").collect()]
    # one aggregate of as many columns as names; a pivot would group the cells by (gene, name) first
    return df.groupBy(gene).agg(*[F.max(F.when(F.col("sample_name") == n, F.col(value))).alias(n) for n in names])


def duplicate_cells(long_df: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with more than one value (the duplicate-key check)."""
    return long_df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def expr_wide_to_long(wide: DataFrame, coldata: DataFrame | None = None, gene: str = "GeneSymbol",
                      sample: str = "sample", grp: str = "grp", value: str = "value") -> DataFrame:
    """Unpivot every non-gene column; attach the group by sample key."""
    cols = [c for c in wide.columns if c != gene]
    long_df = wide.unpivot([gene], cols, sample, value)
    if coldata is not None:
        long_df = long_df.join(coldata.select(sample, grp), sample, "left")
    return long_df


# ---------------------------------------------------------------------------
# Experiment tables
# ---------------------------------------------------------------------------

def se_tables(assays: DataFrame, row_data: DataFrame, col_data: DataFrame,
              assay_name: str | None = None, assay: str = "assay") -> dict[str, DataFrame]:
    """One assay plus its gene and sample tables; default assay = first by
    name; an unknown name raises with the available choices."""
    names = [r[0] for r in assays.select(assay).distinct().orderBy(assay).collect()]
    if not names:
        raise ValueError("no assay present")
    chosen = assay_name or names[0]
    if chosen not in names:
        raise ValueError(f"assay {chosen!r} not found; choices: {', '.join(names)}")
    return {"assay": assays.filter(F.col(assay) == chosen).drop(assay),
            "row_data": row_data, "col_data": col_data}


def se_to_long(assays: DataFrame, col_data: DataFrame, assay_name: str, genes: DataFrame | None = None,
               samples: DataFrame | None = None, coldata_cols: list[str] | None = None,
               gene: str = "gene", sample: str = "sample", assay: str = "assay") -> DataFrame:
    """Chosen genes (a one-column key frame) x chosen samples, long, with
    sample attributes joined on."""
    df = assays.filter(F.col(assay) == assay_name).drop(assay)
    if genes is not None:
        df = df.join(genes.select(F.col(genes.columns[0]).alias(gene)).distinct(), gene, "left_semi")
    if samples is not None:
        df = df.join(samples.select(F.col(samples.columns[0]).alias(sample)).distinct(), sample, "left_semi")
    cd = col_data if coldata_cols is None else col_data.select(sample, *coldata_cols)
    return df.join(cd, sample, "left")


def genes_at_positions(row_data: DataFrame, positions: list[int], pos: str = "pos",
                       gene: str = "gene_id") -> DataFrame:
    """Positions in gene order -> gene names."""
    return row_data.filter(F.col(pos).isin(positions)).select(gene)


def gene_filter(gene_info: DataFrame, gene_types=None, gene_id: str = "gene_id",
                gene_name: str = "gene_name", gene_type: str = "gene_type") -> DataFrame:
    """Keep genes whose biotype is listed (None = all); project id/name/type."""
    lst = parse_list(gene_types)
    df = gene_info if lst is None else gene_info.filter(F.col(gene_type).isin(lst))
    return df.select(F.col(gene_id).alias("gene_id"), F.col(gene_name).alias("gene_name"),
                     F.col(gene_type).alias("gene_type"))


def make_unique(df: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """Repeated names get ``.1``, ``.2``... in order of appearance, skipping
    suffixes that already exist as names (same rule as R's make.unique).

    Rows are numbered within a name by ranges (``keyed_running_sum``), so one
    name on all rows is spread over all tasks.  The i-th repeat of a name takes
    the i-th positive integer that is no suffix of it yet: i plus the number of
    taken suffixes with fewer than i free integers below them, which a running
    count over repeats and suffixes of a name gives.  ``order`` must be total
    within a name; null names stay null.
    """
    numbered = cut_lineage(keyed_running_sum(df, name, [order], F.lit(1), "_no"), "numbered")
    # a suffix blocks k only when it is written as k is (``a.01`` does not block ``a.1``)
    suffix = r"^(?s)(.*)\.([1-9][0-9]{0,17})$"
    taken = (numbered.select(F.col(name).alias("_n")).filter(F.col("_n").rlike(suffix)).distinct()
             .select(F.regexp_extract("_n", suffix, 1).alias("_b"), F.regexp_extract("_n", suffix, 2).cast("long").alias("_k")))
    repeats = numbered.filter(F.col("_no") > 1).select(F.col(name).alias("_b"), (F.col("_no") - 1).alias("_i"))
    taken = taken.join(repeats.select("_b").distinct(), "_b", "left_semi")
    taken = keyed_running_sum(taken, "_b", ["_k"], F.lit(1), "_m").select("_b", (F.col("_k") - F.col("_m")).alias("_i"))
    # a repeat comes before a suffix with as many free integers below it as the repeat's number
    events = (repeats.join(taken.select("_b").distinct(), "_b", "left_semi").withColumn("_taken", F.lit(0))
              .unionByName(taken.withColumn("_taken", F.lit(1))))
    moved = (keyed_running_sum(events, "_b", ["_i", "_taken"], F.col("_taken"), "_skip").filter("_taken = 0")
             .select(F.col("_b").alias("_base"), (F.col("_i") + 1).alias("_row"), "_skip"))
    res = numbered.join(moved, (F.col(name) == F.col("_base")) & (F.col("_no") == F.col("_row")), "left")
    k = F.col("_no") - 1 + F.coalesce("_skip", F.lit(0))
    return res.withColumn(out, F.when(F.col("_no") == 1, F.col(name)).otherwise(
        F.concat(F.col(name), F.lit("."), k.cast("string")))).select(*df.columns, out)


def expr_subset(expr: DataFrame, gene_list: DataFrame, gene_info: DataFrame | None = None,
                relabel: bool = False, gene: str = "gene", pos: str = "pos") -> DataFrame:
    """Expression of listed genes in list order (``gene_list(gene, pos)``);
    raises if no gene matches; ``relabel`` replaces ids by unique symbols.
    The list may be as long as the gene table, so it is never broadcast."""
    gl = gene_list.select(F.col(gene_list.columns[0]).alias(gene), F.col(pos).alias("list_pos"))
    out = expr.join(gl.hint("merge"), gene)
    if out.limit(1).count() == 0:
        raise ValueError("none of the listed genes is present")
    if relabel and gene_info is not None:
        syms = make_unique(gene_info.select(F.col("gene_id").alias(gene), "gene_name", "pos"),
                           "gene_name", "pos", out="symbol").select(gene, "symbol")
        out = out.join(syms, gene, "left").withColumn(gene, F.coalesce(F.col("symbol"), F.col(gene))).drop("symbol")
    return out.orderBy("list_pos", *[c for c in out.columns if c not in ("list_pos",)])


def gene_include_exclude(expr: DataFrame, genes: DataFrame, include: bool = True,
                         gene: str = "gene") -> DataFrame:
    """Semi join (include) or anti join (exclude) on a gene key frame."""
    keys = genes.select(F.col(genes.columns[0]).alias(gene)).distinct()
    return expr.join(keys, gene, "left_semi" if include else "left_anti")


def target_profile(wide: DataFrame, genes: DataFrame, names: list, include: bool = True, gene: str = "gene") -> DataFrame:
    """The rows of a wide profile for the wanted (or all but the unwanted) genes, its value columns renamed to the
    groups' names in order; as many names as value columns, all different."""
    values = [c for c in wide.columns if c != gene]
    if len(names) != len(values) or len({*names, gene}) != len(names) + 1:
        raise ValueError(f"{len(values)} different group names are needed, not {list(names)!r}")
    kept = gene_include_exclude(wide, genes, include, gene)
    return kept.select(gene, *[F.col(f"`{c}`").alias(n) for c, n in zip(values, names)])


def multi_column_filter(df: DataFrame, choices: dict) -> DataFrame:
    """AND over columns of ``IN``; "all"/"All"/empty = no constraint; values
    compared as trimmed strings on both sides."""
    cond = F.lit(True)
    for col, vals in choices.items():
        lst = parse_list(vals)
        if lst is None or any(v in ("all", "All") for v in lst):
            continue
        cond = cond & F.trim(F.col(col).cast("string")).isin(lst)
    return df.filter(cond)


def distinct_choices(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct trimmed values per chosen column in one pass
    ``(column, value)``, sorted."""
    long_df = df.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in cols]).unpivot(
        [], cols, "column", "value")
    return long_df.filter(F.col("value").isNotNull()).distinct().orderBy("column", "value")


def distinct_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows of the chosen columns (the 'without value' table)."""
    return df.select(*cols).distinct()


def tab_coldata_from_columns(long_df: DataFrame, main: str = "main_code",
                             sub: str = "sub_code") -> DataFrame:
    return long_df.select(F.col(main).alias("mainCode"), F.col(sub).alias("subCode")).distinct()


def tab_sample_ids(long_df: DataFrame, main: str = "main_code", sub: str = "sub_code") -> DataFrame:
    """Distinct (main, sub) pairs numbered S001... in (main, sub) order.
    The numbering window sees only the distinct pairs (one per sample)."""
    pairs = long_df.select(main, sub).distinct()
    w = Window.orderBy(main, sub)
    return pairs.withColumn("sample_id", F.format_string("S%03d", F.row_number().over(w)))


def _sample_names(expr: DataFrame, gene_col: str, sample: str | None) -> DataFrame:
    """``mainCode``: the distinct values of a long table's sample column, or a wide table's columns with their ``position``."""
    if sample is None:
        names = F.array(*[F.lit(c) for c in expr.columns if c != gene_col]).cast("array<string>")
        return expr.sparkSession.range(1).select(F.posexplode(names).alias("position", "mainCode"))
    return expr.select(F.col(sample).cast("string").alias("mainCode")).filter("mainCode IS NOT NULL").distinct()


def tab_coldata_grouped(expr: DataFrame, groups: list[str], gene_col: str = "GeneSymbol", sample: str | None = None) -> DataFrame:
    """Sample names and a group vector, joined by position.

    ``expr`` is wide (names are its columns, in their order) or, with ``sample``, a long table (names are the
    distinct values of that column, in their order).  As many groups as names are needed.
    """
    names = _sample_names(expr, gene_col, sample)
    if sample is not None:
        names = global_row_number(names, ["mainCode"], out="n")[0].withColumn("position", F.col("n") - 1)
    names = cut_lineage(names, "samples")
    if (n := names.count()) != len(groups):
        raise ValueError(f"{n} samples but {len(groups)} groups")
    given = expr.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(g) for g in groups]).cast("array<string>")).alias("position", "subCode"))
    return names.join(given, "position").select("mainCode", "subCode")


def tab_coldata_random(expr: DataFrame, gene_col: str = "GeneSymbol", seed: int = 123,
                       labels: tuple = ("T", "NT"), sample: str | None = None) -> DataFrame:
    """Pseudo sample table: the label by the parity of the first digit of
    md5(sample:seed), so the draw is reproducible and independent of
    partitioning.  ``expr`` as in ``tab_coldata_grouped``."""
    digit = F.substring(F.md5(F.concat("mainCode", F.lit(f":{seed}"))), 1, 1)
    return _sample_names(expr, gene_col, sample).select("mainCode", F.when(
        digit.isin(*"02468ace"), F.lit(labels[0])).otherwise(F.lit(labels[1])).alias("subCode"))


def deg_for_genes(deg: DataFrame, genes: DataFrame, gene: str = "GeneSymbol") -> DataFrame:
    return gene_include_exclude(deg, genes, True, gene)


def complete_cases(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with any null or NaN."""
    return df.dropna(how="any", subset=subset)
