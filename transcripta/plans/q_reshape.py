"""Registered projection / filter / reshape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from transcripta.functions.columns import round_numeric
from transcripta.functions.ranking import global_row_number
from transcripta.operators import reshape as rs
from transcripta.plans import fixtures as fx
from transcripta.plans.fixture_sql import SAMPLES
from transcripta.plans.registry import register

# sample names of long_expr: main codes BC000..BC019 (suppkey % 20) x return flags
LONG_NAMES = [f"BC{i:03d}_{f}" for i in range(20) for f in ("A", "N", "R")]

_ATTR_SQL = """
SELECT nullif(regexp_extract(attribute, '.*gene_id "([^"]+)".*', 1), '') AS gene_id,
       nullif(regexp_extract(attribute, '.*gene_name "([^"]+)".*', 1), '') AS Gene,
       TRY_CAST(nullif(regexp_extract(attribute, '.*cov "([^"]+)".*', 1), '') AS DOUBLE) AS cov,
       TRY_CAST(nullif(regexp_extract(attribute, '.*FPKM "([^"]+)".*', 1), '') AS DOUBLE) AS FPKM,
       TRY_CAST(nullif(regexp_extract(attribute, '.*TPM "([^"]+)".*', 1), '') AS DOUBLE) AS TPM
FROM gtf WHERE feature = 'transcript'"""


@register("gtf_attributes", _ATTR_SQL, ("gtf",), doubles=("cov", "FPKM", "TPM"))
def q_gtf_attributes(spark, sf_dir):
    return rs.gtf_attributes(fx.gtf(spark, sf_dir))


@register("gtf_gene_max", f"""
WITH a AS ({_ATTR_SQL})
SELECT Gene, max(cov) AS max_cov, max(FPKM) AS max_FPKM, max(TPM) AS max_TPM FROM a GROUP BY Gene""",
          ("gtf",), doubles=("max_cov", "max_FPKM", "max_TPM"))
def q_gtf_gene_max(spark, sf_dir):
    return rs.gtf_gene_max(rs.gtf_attributes(fx.gtf(spark, sf_dir)))


@register("expr_long_to_wide", "SELECT Gene, " + ", ".join(
    f"max(CASE WHEN main_code || '_' || sub_code = '{n}' THEN value END) AS {n}" for n in LONG_NAMES)
    + " FROM long_expr WHERE normalization = 'max_TPM' GROUP BY Gene", ("long_expr",),
    doubles=tuple(LONG_NAMES))
def q_expr_long_to_wide(spark, sf_dir):
    le = fx.long_expr(spark, sf_dir).filter(F.col("normalization") == "max_TPM")
    return rs.expr_long_to_wide(le, LONG_NAMES)


@register("expr_wide_to_long", """
SELECT n.genes AS GeneSymbol, u.sample, u.value, c.grp FROM normcounts n
JOIN LATERAL (SELECT * FROM (SELECT 1)) ON true,
LATERAL (VALUES """ + ", ".join(f"('{s}', n.{s})" for s in SAMPLES) + """) u(sample, value)
LEFT JOIN coldata c ON c.sample = u.sample""", ("normcounts", "coldata"), doubles=("value",))
def q_expr_wide_to_long(spark, sf_dir):
    wide = fx.normcounts_wide(spark, sf_dir).drop("_c0").withColumnRenamed("genes", "GeneSymbol")
    return rs.expr_wide_to_long(wide, fx.coldata(spark, sf_dir))


def _assays(spark, sf_dir):
    c = fx.counts(spark, sf_dir)
    raw = c.select(F.lit("counts").alias("assay"), "gene", "sample", F.col("value").cast("double").alias("value"))
    logc = c.select(F.lit("logcounts").alias("assay"), "gene", "sample",
                    F.log2(F.col("value") + 1).alias("value"))
    return raw.unionByName(logc)


_ASSAYS_SQL = """
SELECT 'counts' AS assay, gene, sample, CAST(value AS DOUBLE) AS value FROM counts
UNION ALL SELECT 'logcounts', gene, sample, log2(value + 1) FROM counts"""


@register("se_tables", "SELECT gene, sample, value FROM assays WHERE assay = 'logcounts'", ("counts",),
          doubles=("value",), extra=[("assays", _ASSAYS_SQL)])
def q_se_tables(spark, sf_dir):
    se = rs.se_tables(_assays(spark, sf_dir), fx.gene_info(spark, sf_dir), fx.coldata(spark, sf_dir),
                      "logcounts")
    return se["assay"]


@register("se_to_long", """
SELECT a.gene, a.sample, a.value, c.grp FROM assays a
LEFT JOIN coldata c ON c.sample = a.sample
WHERE a.assay = 'counts'
  AND a.gene IN (SELECT gene_id FROM gene_info WHERE gene_type = 'PROMO')
  AND a.sample IN (SELECT sample FROM coldata WHERE grp = 'control')""",
          ("counts", "coldata", "gene_info"), doubles=("value",), extra=[("assays", _ASSAYS_SQL)])
def q_se_to_long(spark, sf_dir):
    gi = fx.gene_info(spark, sf_dir)
    cd = fx.coldata(spark, sf_dir)
    return rs.se_to_long(_assays(spark, sf_dir), cd, "counts",
                         genes=gi.filter(F.col("gene_type") == "PROMO").select("gene_id"),
                         samples=cd.filter(F.col("grp") == "control").select("sample"))


@register("gene_filter", """
SELECT gene_id, gene_name, gene_type FROM gene_info WHERE gene_type IN ('PROMO', 'SMALL')""", ("gene_info",))
def q_gene_filter(spark, sf_dir):
    return rs.gene_filter(fx.gene_info(spark, sf_dir), "PROMO, SMALL")


@register("expr_subset", """
WITH gl AS (SELECT gene_id AS gene, CAST(row_number() OVER (ORDER BY gene_name, pos) AS INTEGER) AS pos
            FROM gene_info WHERE gene_type = 'STANDARD')
SELECT c.gene, c.sample, c.grp, c.value, gl.pos AS list_pos FROM counts c JOIN gl USING (gene)""",
          ("counts", "gene_info"))
def q_expr_subset(spark, sf_dir):
    gi = fx.gene_info(spark, sf_dir).filter(F.col("gene_type") == "STANDARD")
    numbered, _ = global_row_number(gi.select("gene_name", "pos", "gene_id"), ["gene_name", "pos"], out="list_no")
    gl = numbered.select(F.col("gene_id").alias("gene"), F.col("list_no").cast("int").alias("pos"))
    return rs.expr_subset(fx.counts(spark, sf_dir), gl)


_MAKE_UNIQUE_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY gene_name ORDER BY pos) - 1 AS dup FROM gene_info),
names AS (SELECT DISTINCT gene_name AS n FROM gene_info),
need AS (SELECT gene_name AS b, max(dup) AS d FROM r WHERE dup > 0 GROUP BY gene_name),
taken AS (SELECT regexp_extract(n, '^(.*)\\.([1-9]\\d{0,17})$', 1) AS b,
                 CAST(regexp_extract(n, '^(.*)\\.([1-9]\\d{0,17})$', 2) AS BIGINT) AS k
          FROM names WHERE regexp_extract(n, '^(.*)\\.([1-9]\\d{0,17})$', 2) <> ''),
nt AS (SELECT b, count(*) AS t FROM taken GROUP BY b),
cand AS (SELECT need.b, need.d, unnest(range(1, need.d + coalesce(nt.t, 0) + 1)) AS k
         FROM need LEFT JOIN nt USING (b)),
free AS (SELECT b, k, row_number() OVER (PARTITION BY b ORDER BY k) AS dup, d FROM cand
         WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.b = cand.b AND t.k = cand.k)),
f2 AS (SELECT b, k, dup FROM free WHERE dup <= d)
SELECT r.gene_id, r.gene_name, r.gene_type, r.pos,
       CASE WHEN r.dup = 0 THEN r.gene_name ELSE r.gene_name || '.' || CAST(f2.k AS VARCHAR) END AS unique_name
FROM r LEFT JOIN f2 ON f2.b = r.gene_name AND f2.dup = r.dup"""


@register("make_unique", _MAKE_UNIQUE_SQL, ("gene_info",))
def q_make_unique(spark, sf_dir):
    return rs.make_unique(fx.gene_info(spark, sf_dir), "gene_name", "pos")


@register("gene_include_exclude", """
SELECT * FROM counts WHERE gene NOT IN (SELECT gene_id FROM gene_info WHERE gene_type = 'ECONOMY')""",
          ("counts", "gene_info"))
def q_gene_include_exclude(spark, sf_dir):
    gi = fx.gene_info(spark, sf_dir).filter(F.col("gene_type") == "ECONOMY").select("gene_id")
    return rs.gene_include_exclude(fx.counts(spark, sf_dir), gi, include=False)


@register("target_profile", """
SELECT gene, S01 AS tissue, S07 AS ctc FROM (SELECT genes AS gene, S01, S07 FROM normcounts)
WHERE gene IN (SELECT gene_id FROM gene_info WHERE gene_type = 'ECONOMY')""", ("normcounts", "gene_info"), doubles=("tissue", "ctc"))
def q_target_profile(spark, sf_dir):
    """Expression of the wanted genes in two samples, under the groups' names."""
    gi = fx.gene_info(spark, sf_dir).filter(F.col("gene_type") == "ECONOMY").select("gene_id")
    wide = fx.normcounts_wide(spark, sf_dir).select(F.col("genes").alias("gene"), "S01", "S07")
    return rs.target_profile(wide, gi, ["tissue", "ctc"])


@register("multi_column_filter", """
SELECT * FROM long_expr WHERE trim(main_code) IN ('BC001', 'BC002') AND trim(normalization) IN ('max_TPM', 'max_Cov')""",
          ("long_expr",), doubles=("value",))
def q_multi_column_filter(spark, sf_dir):
    return rs.multi_column_filter(fx.long_expr(spark, sf_dir), {
        "main_code": " BC001, BC002", "sub_code": "All", "normalization": ["max_TPM", "max_Cov "]})


@register("distinct_choices", """
SELECT DISTINCT 'main_code' AS "column", trim(main_code) AS value FROM long_expr
UNION SELECT DISTINCT 'sub_code', trim(sub_code) FROM long_expr
UNION SELECT DISTINCT 'normalization', trim(normalization) FROM long_expr""", ("long_expr",))
def q_distinct_choices(spark, sf_dir):
    return rs.distinct_choices(fx.long_expr(spark, sf_dir), ["main_code", "sub_code", "normalization"])


@register("tab_coldata_from_columns", """
SELECT DISTINCT main_code AS mainCode, sub_code AS subCode FROM long_expr""", ("long_expr",))
def q_tab_coldata_from_columns(spark, sf_dir):
    return rs.tab_coldata_from_columns(fx.long_expr(spark, sf_dir))


@register("tab_sample_ids", """
SELECT main_code, sub_code, printf('S%03d', row_number() OVER (ORDER BY main_code, sub_code)) AS sample_id
FROM (SELECT DISTINCT main_code, sub_code FROM long_expr)""", ("long_expr",))
def q_tab_sample_ids(spark, sf_dir):
    return rs.tab_sample_ids(fx.long_expr(spark, sf_dir))


@register("tab_coldata_grouped", """
SELECT DISTINCT sample AS mainCode, grp AS subCode FROM counts""", ("counts",))
def q_tab_coldata_grouped(spark, sf_dir):
    return rs.tab_coldata_grouped(fx.counts(spark, sf_dir), ["control"] * 6 + ["case"] * 6, sample="sample")


@register("tab_coldata_random", """
SELECT DISTINCT sample AS mainCode,
       CASE WHEN instr('02468ace', substr(md5(sample || ':123'), 1, 1)) > 0 THEN 'T' ELSE 'NT' END AS subCode FROM counts""", ("counts",))
def q_tab_coldata_random(spark, sf_dir):
    return rs.tab_coldata_random(fx.counts(spark, sf_dir), sample="sample")


@register("deg_for_genes", """
SELECT * FROM deg WHERE GeneSymbol IN (SELECT gene_id FROM gene_info WHERE gene_type = 'LARGE')""",
          ("deg", "gene_info"), doubles=("logFC", "logCPM", "PValue", "FDR"))
def q_deg_for_genes(spark, sf_dir):
    gi = fx.gene_info(spark, sf_dir).filter(F.col("gene_type") == "LARGE").select("gene_id")
    return rs.deg_for_genes(fx.deg(spark, sf_dir), gi)


@register("round_numeric", """
SELECT GeneSymbol, round(logFC, 5) + 0.0 AS logFC, round(logCPM, 5) + 0.0 AS logCPM,
       printf('%.5e', PValue) AS PValue, printf('%.5e', FDR) AS FDR FROM deg""", ("deg",),
          round_result=False)
def q_round_numeric(spark, sf_dir):
    return round_numeric(fx.deg(spark, sf_dir))


@register("complete_cases", """
SELECT * FROM (SELECT gene, max(value) FILTER (WHERE tissue = 'AFRICA') AS AFRICA,
  max(value) FILTER (WHERE tissue = 'AMERICA') AS AMERICA, max(value) FILTER (WHERE tissue = 'ASIA') AS ASIA,
  max(value) FILTER (WHERE tissue = 'EUROPE') AS EUROPE, max(value) FILTER (WHERE tissue = 'MIDDLE EAST') AS "MIDDLE EAST"
  FROM panel GROUP BY gene)
WHERE AFRICA IS NOT NULL AND AMERICA IS NOT NULL AND ASIA IS NOT NULL AND EUROPE IS NOT NULL
  AND "MIDDLE EAST" IS NOT NULL""", ("panel",), doubles=("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
def q_complete_cases(spark, sf_dir):
    tissues = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = fx.panel(spark, sf_dir).groupBy("gene").pivot("tissue", tissues).agg(F.max("value"))
    return rs.complete_cases(wide)
