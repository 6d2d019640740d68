"""Registered enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from transcripta.operators import de
from transcripta.operators import enrichment as en
from transcripta.plans import fixtures as fx
from transcripta.plans.fixture_sql import bh_sql
from transcripta.plans.registry import register
from transcripta.session import cut_lineage


def _ora_ctes(org: str) -> list[tuple[str, str]]:
    return [
        ("sel", "SELECT GeneSymbol, CASE WHEN logFC > 0.3 THEN 'up' ELSE 'down' END AS direction FROM deg "
                "WHERE PValue < 0.05 AND (logFC > 0.3 OR logFC < -0.3)"),
        ("mp", f"SELECT DISTINCT SYMBOL, ENTREZID FROM id_map WHERE organism = '{org}'"),
        ("lists", "SELECT DISTINCT direction, ENTREZID AS gene FROM sel JOIN mp ON mp.SYMBOL = sel.GeneSymbol"),
        ("s", f"SELECT DISTINCT ontology, term, gene FROM gene_sets WHERE organism = '{org}'"),
        ("u", "SELECT DISTINCT ontology, gene FROM s"),
        ("bn", "SELECT ontology, count(*) AS universe_size FROM u GROUP BY 1"),
        ("lu", "SELECT l.direction, u.ontology, l.gene FROM lists l JOIN u USING (gene)"),
        ("sn", "SELECT direction, ontology, count(*) AS list_size FROM lu GROUP BY 1, 2"),
        ("mm", "SELECT ontology, term, count(*) AS term_size FROM s GROUP BY 1, 2 HAVING count(*) BETWEEN 10 AND 500"),
        ("kk", "SELECT lu.direction, lu.ontology, s.term, count(*) AS Count, "
               "string_agg(lu.gene, '/' ORDER BY lu.gene) AS geneID FROM lu JOIN s USING (ontology, gene) GROUP BY 1, 2, 3"),
        ("cnt", "SELECT kk.direction, kk.ontology, kk.term, Count, term_size, list_size, universe_size, "
                "CAST(Count AS VARCHAR) || '/' || CAST(list_size AS VARCHAR) AS GeneRatio, "
                "CAST(term_size AS VARCHAR) || '/' || CAST(universe_size AS VARCHAR) AS BgRatio, geneID "
                "FROM kk JOIN mm USING (ontology, term) JOIN sn USING (direction, ontology) JOIN bn USING (ontology)"),
        ("hp", """SELECT direction, ontology, term, least(1.0, sum(exp(
            lgamma(tm + 1) - lgamma(x + 1) - lgamma(tm - x + 1)
          + lgamma(us - tm + 1) - lgamma(ls - x + 1) - lgamma(us - tm - ls + x + 1)
          - lgamma(us + 1) + lgamma(ls + 1) + lgamma(us - ls + 1)))) AS pvalue
          FROM (SELECT *, term_size AS tm, list_size AS ls, universe_size AS us,
                       unnest(range(Count, least(term_size, list_size) + 1)) AS x FROM cnt) GROUP BY 1, 2, 3"""),
        ("res", "SELECT cnt.*, hp.pvalue FROM cnt JOIN hp USING (direction, ontology, term)"),
        ("bh", bh_sql("res", "pvalue", "term", "p_adjust", "direction, ontology")),
    ]


_ORA_FX = ("deg", "id_map", "gene_sets")


def _lists(spark, sf_dir, org="hsa"):
    sel = de.deg_select(fx.deg(spark, sf_dir), 0.05, 0.3)
    m = (fx.id_map(spark, sf_dir).filter(F.col("organism") == org)
         .select(F.col("SYMBOL").alias("GeneSymbol"), F.col("ENTREZID").alias("gene")).distinct())
    return sel.join(m, "GeneSymbol").select("direction", "gene")


def _sets(spark, sf_dir, org="hsa"):
    return fx.gene_sets(spark, sf_dir).filter(F.col("organism") == org)


@register("ora_counts", "SELECT * FROM cnt", _ORA_FX, extra=_ora_ctes("hsa"))
def q_ora_counts(spark, sf_dir):
    return en.ora_counts(_lists(spark, sf_dir), _sets(spark, sf_dir))


@register("ora_hypergeom", """
WITH pi AS (SELECT direction, ontology, least(1.0, avg(CASE WHEN pvalue >= 0.05 THEN 1.0 ELSE 0 END) / 0.95) AS pi0 FROM bh GROUP BY 1, 2),
sym AS (SELECT ENTREZID, min(SYMBOL) AS symbol FROM id_map WHERE organism = 'hsa' GROUP BY 1),
rd AS (SELECT direction, ontology, term, string_agg(coalesce(symbol, id), '/' ORDER BY pos) AS geneID
       FROM (SELECT direction, ontology, term, unnest(string_split(geneID, '/')) AS id,
                    generate_subscripts(string_split(geneID, '/'), 1) AS pos FROM bh) LEFT JOIN sym ON sym.ENTREZID = id GROUP BY 1, 2, 3)
SELECT bh.* EXCLUDE (geneID), rd.geneID, CASE WHEN pi0 > 0 THEN pi0 * p_adjust END AS qvalue
FROM bh JOIN pi USING (direction, ontology) JOIN rd USING (direction, ontology, term)""", _ORA_FX,
          doubles=("pvalue", "p_adjust", "qvalue"), extra=_ora_ctes("hsa"))
def q_ora_hypergeom(spark, sf_dir):
    """All directions and ontologies with Storey's q-values and gene symbols."""
    lists, sets = cut_lineage(_lists(spark, sf_dir), "ora-lists"), cut_lineage(_sets(spark, sf_dir), "ora-sets")
    res = cut_lineage(en.ora_hypergeom(en.ora_counts(lists, sets)), "ora-terms")
    return en.readable(en.storey_q(res, ("direction", "ontology")), fx.id_map(spark, sf_dir), "hsa")


@register("ora_by_direction_ontology", "SELECT * FROM bh", _ORA_FX, doubles=("pvalue", "p_adjust"),
          extra=_ora_ctes("hsa"))
def q_ora_by_direction_ontology(spark, sf_dir):
    return en.ora_by_direction_ontology(fx.deg(spark, sf_dir), fx.id_map(spark, sf_dir),
                                        fx.gene_sets(spark, sf_dir), "hsa", 0.05, 0.3)


@register("ora_organism", "SELECT * FROM bh", _ORA_FX, doubles=("pvalue", "p_adjust"), extra=_ora_ctes("mmu"))
def q_ora_organism(spark, sf_dir):
    return en.ora_by_direction_ontology(fx.deg(spark, sf_dir), fx.id_map(spark, sf_dir),
                                        fx.gene_sets(spark, sf_dir), "mmu", 0.05, 0.3)


@register("top_terms", """
SELECT *, CAST(row_number() OVER (PARTITION BY direction, ontology ORDER BY pvalue, term) AS INTEGER) AS rank
FROM bh QUALIFY rank <= 10""", _ORA_FX, doubles=("pvalue", "p_adjust"), extra=_ora_ctes("hsa"))
def q_top_terms(spark, sf_dir):
    res = en.ora_by_direction_ontology(fx.deg(spark, sf_dir), fx.id_map(spark, sf_dir),
                                       fx.gene_sets(spark, sf_dir), "hsa", 0.05, 0.3)
    return en.top_terms(res, 10)


_RANKED = [
    ("mp", "SELECT DISTINCT SYMBOL, ENTREZID FROM id_map WHERE organism = 'hsa'"),
    ("jj", "SELECT d.GeneSymbol, d.logFC, d.PValue, mp.ENTREZID AS gene FROM deg d JOIN mp ON mp.SYMBOL = d.GeneSymbol "
           "WHERE mp.ENTREZID IS NOT NULL"),
    ("ff", "SELECT gene, first(logFC ORDER BY PValue NULLS LAST, GeneSymbol) AS m FROM jj GROUP BY gene"),
    ("ranked", "SELECT direction, gene, m * sign AS metric, "
               "CAST(row_number() OVER (PARTITION BY direction ORDER BY m * sign DESC, gene) AS INTEGER) AS pos, "
               "count(*) OVER (PARTITION BY direction) AS N "
               "FROM ff, (VALUES ('up', 1.0::DOUBLE), ('down', -1.0::DOUBLE)) v(direction, sign) WHERE m IS NOT NULL"),
]


def _both(spark, sf_dir, run):
    """``run`` of the ranked list of each direction, under one ``direction`` column; the DEG table is made once."""
    deg, ids = cut_lineage(fx.deg(spark, sf_dir), "deg"), fx.id_map(spark, sf_dir)
    up, down = (run(en.gsea_ranked_list(deg, ids, "hsa", d)).withColumn("direction", F.lit(d)) for d in ("up", "down"))
    return up.unionByName(down)


@register("gsea_ranked_list", "SELECT * FROM ranked", ("deg", "id_map"), doubles=("metric",), extra=_RANKED)
def q_gsea_ranked_list(spark, sf_dir):
    return _both(spark, sf_dir, lambda ranked: ranked)


@register("gsea_score", """
WITH h AS (SELECT r.direction, s.ontology, s.term, r.gene, r.metric, r.pos, r.N FROM ranked r
           JOIN (SELECT DISTINCT ontology, term, gene FROM gene_sets WHERE organism = 'hsa') s USING (gene)),
h2 AS (SELECT *, count(*) OVER t AS M FROM h WINDOW t AS (PARTITION BY direction, ontology, term)),
h3 AS (SELECT *, abs(metric) AS w FROM h2 WHERE M BETWEEN 1 AND 500),
h4 AS (SELECT *, sum(w) OVER t AS nr, row_number() OVER o AS j,
              sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw FROM h3
       WINDOW t AS (PARTITION BY direction, ontology, term), o AS (PARTITION BY direction, ontology, term ORDER BY pos)),
h5 AS (SELECT *, cw / nr - (pos - j) / (N - M) AS top FROM h4),
agg AS (SELECT direction, ontology, term, max(M) AS setSize, max(top) AS ES FROM h5 GROUP BY 1, 2, 3),
atm AS (SELECT h5.direction, h5.ontology, h5.term, min(pos) AS rank_at_max FROM h5
        JOIN agg USING (direction, ontology, term) WHERE h5.top = agg.ES GROUP BY 1, 2, 3),
le AS (SELECT h5.direction, h5.ontology, h5.term, string_agg(gene, '/' ORDER BY pos) AS leading_edge, count(*) AS core_size
       FROM h5 JOIN atm USING (direction, ontology, term) WHERE pos <= rank_at_max GROUP BY 1, 2, 3)
SELECT direction, ontology, term, setSize, ES, rank_at_max, leading_edge, core_size
FROM agg JOIN atm USING (direction, ontology, term) LEFT JOIN le USING (direction, ontology, term)""",
          ("deg", "id_map", "gene_sets"), doubles=("ES",), extra=_RANKED)
def q_gsea_score(spark, sf_dir):
    sets = _sets(spark, sf_dir)
    return _both(spark, sf_dir, lambda ranked: en.gsea_score(cut_lineage(ranked, "ranked-genes"), sets, 1, 500, 1.0, "pos", ("ontology",)))


@register("gsea_permutation")
def q_gsea_permutation(spark, sf_dir):
    sets = _sets(spark, sf_dir)

    def run(ranked):
        ranked = cut_lineage(ranked, "ranked-genes")
        scores = en.gsea_score(ranked, sets, 1, 500, 1.0, "pos", ("ontology",))
        return en.gsea_permutation(ranked, scores, n_perm=1000, seed=22, score_type="pos", set_keys=("ontology",))

    return _both(spark, sf_dir, run)
