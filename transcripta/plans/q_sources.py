"""Registered source / catalog / sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from transcripta.plans import fixtures as fx
from transcripta.plans.fixture_sql import ROLE_SQL, SAMPLES, TIME_SQL, TIME_STR_SQL
from transcripta.plans.registry import register
from transcripta.session import scratch_path
from transcripta.sources import catalog, files


@register("src_match_tables", """
SELECT database, substr(database, 1, length(database) - 6) AS label, min(name) AS name
FROM run_tables WHERE ends_with(database, '_alice') AND regexp_matches(name, '^normcounts_')
GROUP BY database""", ("run_tables",))
def q_src_match_tables(spark, sf_dir):
    return catalog.src_match_tables(fx.run_tables(spark, sf_dir), "Alice", "^normcounts_")


@register("src_latest_run", f"""
WITH t AS (SELECT database, name, {TIME_STR_SQL.format(n='name')} AS time_str,
                  {TIME_SQL.format(n='name')} AS time FROM run_tables)
SELECT *, coalesce(time = max(time) OVER (), false) AS is_latest FROM t""", ("run_tables",))
def q_src_latest_run(spark, sf_dir):
    return catalog.src_latest_run(fx.run_tables(spark, sf_dir))


@register("src_table_roles", f"""
SELECT database, name, {ROLE_SQL.format(n='name')} AS role FROM run_tables""", ("run_tables",))
def q_src_table_roles(spark, sf_dir):
    return catalog.src_table_roles(fx.run_tables(spark, sf_dir))


@register("src_normalise_columns", f"""
SELECT genes AS GeneSymbol, {', '.join(SAMPLES)} FROM normcounts""", ("normcounts",),
          doubles=tuple(SAMPLES))
def q_src_normalise_columns(spark, sf_dir):
    return catalog.src_normalise_columns(fx.normcounts_wide(spark, sf_dir))


@register("src_load_run", """
WITH y AS (SELECT 'G' || CAST(l_partkey AS VARCHAR) AS gene, month(l_shipdate) AS m, year(l_shipdate) AS y, sum(l_quantity) AS v
           FROM lineitem GROUP BY ALL),
n AS (SELECT gene, 'S' || lpad(CAST(m AS VARCHAR), 2, '0') AS sample, CASE WHEN m <= 6 THEN 'control' ELSE 'case' END AS grp,
             CAST(v AS DOUBLE) AS v, CAST(y AS VARCHAR) || '0101t000000z' AS run FROM y WHERE y = (SELECT max(y) FROM y))
SELECT 'expression' AS role, 'normcounts_' || run AS source_table, gene AS item, sample AS field, v AS value, NULL::VARCHAR AS label FROM n
UNION ALL SELECT 'deg', 'exacttest_' || run, gene, 'logFC', log2(coalesce(sum(v) FILTER (WHERE grp = 'case'), 0) + 1)
                 - log2(coalesce(sum(v) FILTER (WHERE grp = 'control'), 0) + 1), NULL FROM n GROUP BY run, gene
UNION ALL SELECT DISTINCT 'samples', 'coldata_' || run, sample, 'subCode', NULL, grp FROM n""", doubles=("value",))
def q_src_load_run(spark, sf_dir):
    """Store the three tables of one run per ship year, list the catalog, load the newest run by the names listed."""
    database = f"runs_{uuid.uuid4().hex[:12]}"
    listing = catalog.src_store_runs(spark, database, scratch_path(spark, "runs"), fx.run_frames(spark, sf_dir))

    def reader(name):
        return spark.read.table(f"`{database}`.`{name}`").withColumn("source_table", F.lit(name))

    run = catalog.src_load_run(spark, listing, reader=reader)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = run["expression"].unpivot(["source_table", "GeneSymbol"], SAMPLES, "field", "value").filter(F.col("value").isNotNull())
    return (cells.select(F.lit("expression").alias("role"), "source_table", F.col("GeneSymbol").alias("item"), "field", "value",
                         text.alias("label"))
            .unionByName(run["deg"].select(F.lit("deg").alias("role"), "source_table", F.col("GeneSymbol").alias("item"),
                                           F.lit("logFC").alias("field"), F.col("logFC").alias("value"), text.alias("label")))
            .unionByName(run["samples"].select(F.lit("samples").alias("role"), "source_table", F.col("mainCode").alias("item"),
                                               F.lit("subCode").alias("field"), none.alias("value"), F.col("subCode").alias("label"))))


@register("src_expr_query", """
SELECT * FROM long_expr WHERE main_code IN ('BC001', 'BC002', 'BC005') AND sub_code IN ('A', 'R')
AND normalization IN ('max_TPM')""", ("long_expr",), doubles=("value",))
def q_src_expr_query(spark, sf_dir):
    return catalog.src_expr_query(fx.long_expr(spark, sf_dir), " BC001, BC002,BC005", ["A", "R"], "max_TPM")


@register("src_read_gtf", """
SELECT *, CASE WHEN (start // 10) % 2 = 0 THEN 'tissue' ELSE 'ctc' END AS "group" FROM gtf""", ("gtf",))
def q_src_read_gtf(spark, sf_dir):
    """Write the derived GTF as two groups of text files, read them back."""
    g = fx.gtf(spark, sf_dir)
    even = files.write_gtf(g.filter((F.col("start") / 10) % 2 == 0), scratch_path(spark, "gtf_tissue"))
    odd = files.write_gtf(g.filter((F.col("start") / 10) % 2 == 1), scratch_path(spark, "gtf_ctc"))
    return files.src_read_gtf(spark, {"tissue": even, "ctc": odd})


@register("src_read_gct", "SELECT gene, tissue, value FROM panel WHERE value IS NOT NULL", ("panel",),
          doubles=("value",))
def q_src_read_gct(spark, sf_dir):
    """Write the derived tissue panel as GCT text, read it back long."""
    p = fx.panel(spark, sf_dir)
    tissues = [r[0] for r in p.select("tissue").distinct().orderBy("tissue").collect()]
    path = files.write_gct(p, scratch_path(spark, "panel_gct"), tissues)
    return files.src_read_gct(spark, path).filter(F.col("value").isNotNull())


@register("sink_csv")
def q_sink_csv(spark, sf_dir):
    """Write the DEG table as CSV partitioned by sign of logFC; read back."""
    d = fx.deg(spark, sf_dir).withColumn("sign", F.when(F.col("logFC") >= 0, "pos").otherwise("neg"))
    path = files.sink_csv(d, scratch_path(spark, "deg_csv"), partition_by=["sign"])
    return spark.read.option("header", "true").option("inferSchema", "false").csv(path)
