"""Gene-set over-representation (hypergeometric) and GSEA.

Gene sets are input tables ``gene_sets(ontology, term, gene)``.  All panels
(direction x ontology) run in one job: the panel columns are ordinary
grouping keys.  The hypergeometric tail is a sum of exp(log pmf) over an
exploded range of at most min(M, n) values per term, with log-factorials
as Column expressions (exact table up to 20, Stirling above).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcripta.functions.stats import bh_adjust, log_choose
from transcripta.session import cut_lineage, ship_package


def ora_counts(lists: DataFrame, sets: DataFrame, list_keys: tuple = ("direction",),
               set_keys: tuple = ("ontology",), min_size: int = 10, max_size: int = 500,
               gene: str = "gene") -> DataFrame:
    """Per panel and term: overlap k, term size M, list size n, universe N.

    Universe = genes annotated in the panel's ontology; the list counts only
    annotated genes; terms need M in [min_size, max_size] and k >= 1.
    GeneRatio = 'k/n', BgRatio = 'M/N', geneID = sorted overlap ids 'a/b/c'.
    """
    lk, sk = list(list_keys), list(set_keys)
    s = sets.select(*sk, "term", F.col(gene).alias("gene")).distinct()
    universe = s.select(*sk, "gene").distinct()
    big_n = universe.groupBy(*sk).agg(F.count(F.lit(1)).alias("universe_size"))
    lst = lists.select(*lk, F.col(gene).alias("gene")).distinct()
    lu = lst.join(universe, "gene")
    small_n = lu.groupBy(*lk, *sk).agg(F.count(F.lit(1)).alias("list_size"))
    m = (s.groupBy(*sk, "term").agg(F.count(F.lit(1)).alias("term_size"))
         .filter((F.col("term_size") >= min_size) & (F.col("term_size") <= max_size)))
    hits = lu.join(s, sk + ["gene"])
    k = hits.groupBy(*lk, *sk, "term").agg(
        F.count(F.lit(1)).alias("Count"),
        F.concat_ws("/", F.sort_array(F.collect_list("gene"))).alias("geneID"))
    res = k.join(m, sk + ["term"]).join(small_n, lk + sk).join(big_n, sk)
    return res.select(
        *lk, *sk, "term", "Count", "term_size", "list_size", "universe_size",
        F.concat(F.col("Count").cast("string"), F.lit("/"), F.col("list_size").cast("string")).alias("GeneRatio"),
        F.concat(F.col("term_size").cast("string"), F.lit("/"), F.col("universe_size").cast("string")).alias("BgRatio"),
        "geneID")


def ora_hypergeom(counts: DataFrame, panel_keys: tuple = ("direction", "ontology"),
                  p_cut: float = 1.0, q_cut: float = 1.0, q_lambdas: tuple = (0.05,)) -> DataFrame:
    """Upper-tail hypergeometric p per term and BH within each panel;
    cut-offs default 1 (keep all).  ``q_cut`` below 1 cuts Storey's q-value,
    which is then a column too (see ``storey_q``)."""
    pk = list(panel_keys)
    big_m, n, big_n = F.col("term_size"), F.col("list_size"), F.col("universe_size")
    ex = counts.select(*pk, "term", "Count", "term_size", "list_size", "universe_size",
                       F.explode(F.sequence(F.col("Count"), F.least("term_size", "list_size"))).alias("x"))
    lp = (log_choose(big_m, F.col("x")) + log_choose(big_n - big_m, n - F.col("x"))
          - log_choose(big_n, n))
    p = ex.groupBy(*pk, "term").agg(F.least(F.lit(1.0), F.sum(F.exp(lp))).alias("pvalue"))
    res = counts.join(p, pk + ["term"])
    res = bh_adjust(res, "pvalue", "term", "p_adjust", pk)
    if q_cut < 1:
        res = storey_q(res, pk, lambdas=q_lambdas).filter(F.col("qvalue") <= q_cut)
    return res.filter(F.col("pvalue") <= p_cut)


def storey_pi0(res: DataFrame, panel_keys: tuple = (), p: str = "pvalue", lambdas: tuple = (0.05,)) -> DataFrame:
    """``panel..., pi0``: the proportion of true nulls of each panel (Storey 2002), null when it is not above 0.

    One lambda: the share of p at or above it, over 1 - lambda.  Several: the
    estimate with the least mean squared error about their lower decile (the
    closed form of Storey, Taylor and Siegmund 2004 for the bootstrap).
    """
    lam = sorted(lambdas)
    rows = res.filter(F.col(p).isNotNull() & ~F.isnan(p))
    m = F.col("_m")
    each = rows.groupBy(*panel_keys).agg(F.count(F.lit(1)).alias("_m"), *[F.sum(F.when(F.col(p) >= x, 1).otherwise(0)).alias(f"_w{i}") for i, x in enumerate(lam)])
    raw = [F.col(f"_w{i}") / m / (1 - x) for i, x in enumerate(lam)]
    if len(lam) == 1:
        best = raw[0]
    else:
        at = 0.1 * (len(lam) - 1)
        low, f = int(at), at - int(at)
        each = each.withColumn("_pi", F.array(*raw)).withColumn("_sorted", F.sort_array("_pi"))
        decile = F.col("_sorted")[low] * (1 - f) + F.col("_sorted")[min(low + 1, len(lam) - 1)] * f
        each = each.withColumn("_decile", decile)
        errors = F.array(*[F.struct((F.col(f"_w{i}") / (m * m * (1 - x) ** 2) * (1 - F.col(f"_w{i}") / m)
                                     + F.pow(F.col("_pi")[i] - F.col("_decile"), 2)).alias("mse"), F.col("_pi")[i].alias("pi0"))
                           for i, x in enumerate(lam)])
        best = F.array_min(errors)["pi0"]
    pi0 = F.least(F.lit(1.0), best)
    return each.select(*panel_keys, F.when(pi0 > 0, pi0).alias("pi0"))


def storey_q(res: DataFrame, panel_keys: tuple = (), p: str = "pvalue", adjusted: str = "p_adjust", lambdas: tuple = (0.05,),
             out: str = "qvalue") -> DataFrame:
    """Adds the q-value: the panel's proportion of true nulls times the Benjamini-Hochberg rate (null without one)."""
    pk = list(panel_keys)
    res = res.withColumn("_one", F.lit(1))
    pi0 = storey_pi0(res, ["_one", *pk], p, lambdas)  # one row per panel
    return res.join(pi0, ["_one", *pk], "left").withColumn(out, F.col("pi0") * F.col(adjusted)).drop("pi0", "_one")


def readable(res: DataFrame, id_map: DataFrame, organism: str, keys: tuple = ("direction", "ontology", "term"), ids: str = "geneID") -> DataFrame:
    """Gene ids in ``ids`` ('a/b/c') as symbols, in the same order; an id without a symbol stays (of several symbols the first by name)."""
    k = list(keys)
    symbol = (id_map.filter((F.col("organism") == organism) & F.col("ENTREZID").isNotNull())
              .groupBy(F.col("ENTREZID").alias("_id")).agg(F.min("SYMBOL").alias("_symbol")))
    each = res.select(*k, F.posexplode(F.split(ids, "/")).alias("_pos", "_id")).join(symbol, "_id", "left")
    names = each.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("_symbol", "_id").alias("_name")))).alias("_names"))
    return res.join(names, k, "left").withColumn(ids, F.concat_ws("/", F.col("_names._name"))).drop("_names").select(*res.columns)


def ora_by_direction_ontology(deg: DataFrame, id_map: DataFrame, sets: DataFrame, organism: str = "hsa",
                              p_cut: float = 0.05, lfc_cut: float = 1.0, min_size: int = 10,
                              max_size: int = 500, gene: str = "GeneSymbol") -> DataFrame:
    """ORA for {up, down} x every ontology of the organism in one job."""
    from transcripta.operators.de import deg_select
    sel = deg_select(deg, p_cut, lfc_cut)
    m = (id_map.filter(F.col("organism") == organism)
         .select(F.col("SYMBOL").alias(gene), F.col("ENTREZID").alias("gene")).distinct())
    lists = sel.join(m, gene).select("direction", "gene")
    # genes of the lists and of the sets, read several times: written once
    lists = cut_lineage(lists, "ora-lists")
    s = cut_lineage(sets.filter(F.col("organism") == organism), "ora-sets")
    counts = ora_counts(lists, s, ("direction",), ("ontology",), min_size, max_size)
    return ora_hypergeom(counts, ("direction", "ontology"))


def top_terms(res: DataFrame, n: int = 10, panel_keys: tuple = ("direction", "ontology"),
              p_col: str = "pvalue") -> DataFrame:
    """The n best terms of each panel (by p, then term)."""
    w = Window.partitionBy(*panel_keys).orderBy(F.col(p_col), F.col("term"))
    return res.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# ---------------------------------------------------------------------------
# GSEA
# ---------------------------------------------------------------------------

def gsea_ranked_list(deg: DataFrame, id_map: DataFrame, organism: str = "hsa", direction: str = "up",
                     gene: str = "GeneSymbol", metric: str = "logFC", p_col: str = "PValue",
                     distributed: bool = True) -> DataFrame:
    """Ranked list ``(gene, metric, pos, N)``: DEG joined to ids, first row
    per id (by p, then symbol), metric = logFC (up) or -logFC (down), positions
    by metric desc then id, numbered by range partitions (in one window unless
    ``distributed``)."""
    m = (id_map.filter(F.col("organism") == organism)
         .select(F.col("SYMBOL").alias(gene), F.col("ENTREZID").alias("gene")).distinct())
    j = deg.select(gene, metric, p_col).join(m, gene).filter(F.col("gene").isNotNull())
    first = j.groupBy("gene").agg(F.min_by(F.col(metric), F.struct(F.col(p_col).isNull(), F.col(p_col), F.col(gene))).alias("m"))
    sign = 1.0 if direction == "up" else -1.0
    ranked = first.select("gene", (F.col("m") * sign).alias("metric")).filter(F.col("metric").isNotNull())
    if distributed:
        from transcripta.functions.ranking import global_row_number
        n = ranked.count()
        numbered, _ = global_row_number(ranked, [F.col("metric").desc(), F.col("gene")], "pos")
        return (numbered.withColumn("pos", F.col("pos").cast("int"))
                .withColumn("N", F.lit(n).cast("long")))
    w = Window.orderBy(F.col("metric").desc(), F.col("gene"))
    return (ranked.withColumn("pos", F.row_number().over(w))
            .withColumn("N", F.count(F.lit(1)).over(Window.partitionBy())))


def gsea_score(ranked: DataFrame, sets: DataFrame, min_size: int = 1, max_size: int = 500,
               exponent: float = 1.0, score_type: str = "pos", set_keys: tuple = ()) -> DataFrame:
    """Running-sum enrichment score per term from its hits only.

    With weights w = |metric|^exponent, NR = sum of hit weights, the value
    just after hit j is cumsum(w)/NR - (pos_j - j)/(N - M) and just before
    it that minus w_j/NR; ES is the max after-value ("pos"), the min
    before-value ("neg"), or the larger in absolute value ("std").  The
    leading edge is the hits up to the extreme.
    """
    sk = list(set_keys)
    hits = ranked.join(sets.select(*sk, "term", "gene").distinct(), "gene")
    wt = Window.partitionBy(*sk, "term")
    hits = (hits.withColumn("M", F.count(F.lit(1)).over(wt))
            .filter((F.col("M") >= min_size) & (F.col("M") <= max_size)))
    w = F.pow(F.abs(F.col("metric")), F.lit(exponent))
    wo = wt.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (hits.withColumn("_w", w)
            .withColumn("_nr", F.sum("_w").over(wt))
            .withColumn("_j", F.row_number().over(wt.orderBy("pos")))
            .withColumn("_cw", F.sum("_w").over(wo)))
    # no weight among the hits, or no gene outside the set: that side of the sum stays 0
    none = F.lit(0.0)
    top = (F.coalesce(F.try_divide(F.col("_cw"), F.col("_nr")), none)
           - F.coalesce(F.try_divide(F.col("pos") - F.col("_j"), F.col("N") - F.col("M")), none))
    hits = hits.withColumn("_top", top).withColumn("_bot", F.col("_top") - F.coalesce(F.try_divide(F.col("_w"), F.col("_nr")), none))
    agg = hits.groupBy(*sk, "term").agg(
        F.first("M").alias("setSize"),
        F.max_by("pos", F.struct(F.col("_top"), -F.col("pos"))).alias("_pmax"),
        F.max("_top").alias("_maxp"),
        F.min_by("pos", F.struct(F.col("_bot"), F.col("pos"))).alias("_pmin"),
        F.min("_bot").alias("_minp"))
    if score_type == "pos":
        es, at = F.col("_maxp"), F.col("_pmax")
    elif score_type == "neg":
        es, at = F.col("_minp"), F.col("_pmin")
    else:
        es = (F.when(F.col("_maxp") == -F.col("_minp"), F.lit(0.0))
              .when(F.col("_maxp") > -F.col("_minp"), F.col("_maxp")).otherwise(F.col("_minp")))
        at = F.when(F.col("_maxp") >= -F.col("_minp"), F.col("_pmax")).otherwise(F.col("_pmin"))
    agg = agg.select(*sk, "term", "setSize", es.alias("ES"), at.alias("rank_at_max"))
    lead_pos = (F.col("pos") <= F.col("rank_at_max")) if score_type != "neg" else (F.col("pos") >= F.col("rank_at_max"))
    le = (hits.join(agg.select(*sk, "term", "rank_at_max", "ES"), sk + ["term"])
          .filter(F.when(F.col("ES") >= 0, F.col("pos") <= F.col("rank_at_max"))
                  .otherwise(F.col("pos") >= F.col("rank_at_max")) if score_type == "std" else lead_pos)
          .groupBy(*sk, "term")
          .agg(F.concat_ws("/", F.transform(F.sort_array(F.collect_list(F.struct("pos", "gene"))),
                                            lambda s: s["gene"])).alias("leading_edge"),
               F.count(F.lit(1)).alias("core_size")))
    return agg.join(le, sk + ["term"], "left")


#: positions of the ranked list in one slice
SLICE = 1 << 16


def null_sequence(seed: int, perm: int, n: int, most: int) -> np.ndarray:
    """Distinct 0-based positions in random order; its first m are the null set of size m of this permutation."""
    return np.random.default_rng([seed, perm]).choice(n, size=min(most, n), replace=False)


def null_scores(ranked: DataFrame, sizes: list[int], n_perm: int, seed: int, score_type: str = "pos",
                n_chunks: int = 8, slice_size: int = SLICE) -> DataFrame:
    """``m, perm, null_es`` of random sets of every size over ``ranked(pos, w)``, without rows for the drawn places.

    The list is cut into slices of its positions.  Every (slice, chunk of
    permutations) draws the same sequences from their seeds and looks only at
    the places in its slice.  A first pass gives the slices' weights and hits,
    from which Spark makes what lies before each slice and the whole weight; a
    second pass takes the extremes of the running sums.
    """
    spark = ranked.sparkSession
    ship_package(spark)
    ranked = cut_lineage(ranked.select("pos", "w"), "ranked-list")
    n = ranked.count()
    sizes = sorted({int(m) for m in sizes if m <= n})
    schema = "m int, perm int, null_es double"
    if not sizes:
        return spark.createDataFrame([], schema)
    per = max(1, -(-n_perm // n_chunks))
    cells = F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long"), F.col("w"))))
    at = F.floor((F.col("pos") - 1) / slice_size).cast("int")
    slices = ranked.groupBy(at.alias("slice")).agg(cells.alias("cells")).select("slice", F.col("cells.w").alias("weights"))
    work = cut_lineage(slices.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-n_perm // per) - 1)))), "list-slices")
    work = work.repartition(min(1024, n_chunks * max(1, -(-n // slice_size))), "slice", "chunk")

    def drawn(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Permutations of the chunk; per permutation and draw: position, whether it is in the slice, its weight."""
        perms = np.arange(row["chunk"] * per, min(n_perm, (row["chunk"] + 1) * per))
        pos = np.stack([null_sequence(seed, int(b), n, sizes[-1]) for b in perms])
        weights = np.asarray(row["weights"], float)
        inside = pos // slice_size == row["slice"]
        return perms, pos, inside, np.where(inside, weights[np.where(inside, pos - row["slice"] * slice_size, 0)], 0.0)

    pick = np.array(sizes) - 1

    def totals(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                perms, _, inside, w = drawn(row)
                yield pd.DataFrame({"slice": row["slice"], "chunk": row["chunk"], "perm": np.repeat(perms, len(sizes)), "m": np.tile(sizes, len(perms)),
                                    "w": np.cumsum(w, 1)[:, pick].ravel(), "hits": np.cumsum(inside, 1)[:, pick].ravel()})

    part = cut_lineage(work.mapInPandas(totals, "slice int, chunk int, perm int, m int, w double, hits long"), "null-totals")
    one = Window.partitionBy("perm", "m")  # as many rows as slices
    before = one.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("slice", "chunk", "perm", "m", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w"),
                       F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("hits"), F.sum("w").over(one).alias("nr"))

    def extremes(key, slices_, before_):
        row = {"slice": int(key[0]), "chunk": int(key[1]), "weights": slices_["weights"].iloc[0]}
        perms, pos, inside, w = drawn(row)
        known = before_.set_index(["m", "perm"]).sort_index()
        out = []
        for m in sizes:
            k = known.loc[m].loc[perms]
            p = np.where(inside[:, :m], pos[:, :m], n)
            order = np.argsort(p, 1)
            p, x = np.take_along_axis(p, order, 1), np.take_along_axis(w[:, :m], order, 1)
            nr = k["nr"].to_numpy()[:, None]
            hit = np.cumsum(x, 1) + k["w"].to_numpy()[:, None]
            j = np.arange(1, m + 1)[None, :] + k["hits"].to_numpy()[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                # no weight among the hits, or no gene outside the set: that side of the sum stays 0
                top = np.where(nr > 0, hit / nr, 0.0) - ((p + 1 - j) / (n - m) if n > m else 0.0)
                low = top - np.where(nr > 0, x / nr, 0.0)
            real = p < n
            out.append(pd.DataFrame({"m": m, "perm": perms, "mx": np.where(real, top, -np.inf).max(1), "mn": np.where(real, low, np.inf).min(1)}))
        return pd.concat(out)

    ends = work.groupBy("slice", "chunk").cogroup(part.groupBy("slice", "chunk")).applyInPandas(extremes, "m int, perm int, mx double, mn double")
    mx, mn = F.max("mx"), F.min("mn")
    es = {"pos": mx, "neg": mn}.get(score_type, F.when(mx == -mn, F.lit(0.0)).when(mx > -mn, mx).otherwise(mn))
    # a score of 0 but for rounding has no sign
    return ends.groupBy("m", "perm").agg(es.alias("null_es")).withColumn("null_es", F.when(F.abs("null_es") < 1e-12, 0.0).otherwise(F.col("null_es")))


def gsea_permutation(ranked: DataFrame, scores: DataFrame, n_perm: int = 1000, seed: int = 22,
                     exponent: float = 1.0, score_type: str = "pos", n_chunks: int = 8,
                     set_keys: tuple = (), slice_size: int = SLICE) -> DataFrame:
    """NES, p and BH FDR from random gene sets of the same size.

    A permutation is one random sequence of positions; its first m places are
    the null set of every set of size m, so results depend on the seed only.
    No drawn place is ever a row (see ``null_scores``).  NES is null when no
    null score has the sign of ES.
    """
    # one row per term, reused: written once
    sk = list(set_keys)
    scores = cut_lineage(scores.select(*sk, "term", "setSize", "ES"), "observed_scores")
    sizes = [r[0] for r in scores.select("setSize").distinct().collect()]  # at most as many as the largest set has genes
    weights = ranked.select("pos", F.pow(F.abs(F.col("metric")), F.lit(exponent)).alias("w"))
    nulls = null_scores(weights, sizes, n_perm, seed, score_type, n_chunks, slice_size)
    j = scores.join(nulls, scores["setSize"].cast("int") == nulls["m"])
    pos_side = F.col("ES") >= 0
    agg = j.groupBy(*sk, "term").agg(
        F.first("ES").alias("ES"), F.first("setSize").alias("setSize"),
        F.avg(F.when(F.col("null_es") >= 0, F.col("null_es"))).alias("_mp"),
        F.avg(F.when(F.col("null_es") < 0, F.col("null_es"))).alias("_mn"),
        F.sum(F.when(pos_side & (F.col("null_es") >= F.col("ES")), 1).otherwise(0)).alias("_gp"),
        F.sum(F.when(~pos_side & (F.col("null_es") <= F.col("ES")), 1).otherwise(0)).alias("_gn"),
        F.sum(F.when(F.col("null_es") >= 0, 1).otherwise(0)).alias("_np"),
        F.sum(F.when(F.col("null_es") < 0, 1).otherwise(0)).alias("_nn"))
    res = agg.select(
        *sk, "term", "setSize", "ES",
        F.when(pos_side, F.try_divide(F.col("ES"), F.col("_mp"))).otherwise(F.try_divide(-F.col("ES"), F.col("_mn"))).alias("NES"),
        F.when(pos_side, (F.col("_gp") + 1) / (F.col("_np") + 1))
        .otherwise((F.col("_gn") + 1) / (F.col("_nn") + 1)).alias("pvalue"))
    return bh_adjust(res, "pvalue", "term", "p_adjust", sk)
